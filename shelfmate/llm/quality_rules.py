"""Quality rules as a ledger of failure bits.

``ledger`` measures every text once and evaluates every rule once; it keeps the measurements and
one bit per failed rule. A policy is a version with the set of rules it enforces, so applying another version, or
asking what a rule contributes, reads the narrow ledger and never the texts:

- ``apply_policy`` keeps the rows none of whose failure bits are in the policy's mask;
- ``ablation`` counts, per rule of a policy, the rows that fail it and those that only this rule
  rejects, from one aggregation by failure pattern (at most 2^rules rows).

Words are runs ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has no words, so it measures 0
throughout and fails ``few_words``. Repeated rows are measured each. Only the key and text columns are
read, so other columns cannot clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.llm.common import prepare, read_table, whole_row

#: Fixed values of the task: symbols counted, and the window in words.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_SYMBOLS = [s.encode() for s in SYMBOLS]
_STARTS = bytes(range(0x80)) + bytes(range(0xC0, 0x100))
_BLANK = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_NOT_CAPITALS = bytes(set(range(256)) - set(_CAPITALS))
_NOT_LETTERS = bytes(set(range(256)) - set(_LETTERS))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals"]

#: (name, SQL condition of failure over the measurements). The place in the list is the bit; append only.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 40 * n_letters"),
]

#: Versions of the policy: the rules each one enforces.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines"],
    "v2": [name for name, _ in RULES],
}


def repeated_words(words: list) -> int:
    """Words inside windows of five that occur at least twice in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, reached = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + WINDOW - max(i, reached)
            reached = i + WINDOW
    return covered


def measure(text: bytes) -> tuple:
    words = text.split()  # splits bytes at exactly the six white space characters
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return (
        len(words),
        sum(map(len, words)) - len(text.translate(None, _STARTS)),  # less the bytes that continue a code point
        sum(text.count(s) for s in _SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text.translate(None, _NOT_LETTERS)),
        len(text.translate(None, _NOT_CAPITALS)),
    )


def _measured(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        rows = [measure(t.as_py() or b"") for t in texts]
        columns = list(zip(*rows)) or [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[batch.schema.names[0], *MEASURES]
        )


def mask(names) -> int:
    bits = {name: 1 << place for place, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in set(names))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measurements, and ``failures``, a bit for every failed rule."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = T.StructType([narrow.schema[0], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = narrow.mapInArrow(_measured, schema)
    bits = [F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)) for place, (_, condition) in enumerate(RULES)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures.cast("long"))


def rejected(version: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) != 0


def apply_policy(book: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``kept``: no rule of this version failed."""
    return book.withColumn("kept", ~rejected(version))


def ablation(book: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of the policy: rows failing it, and rows that would stay if only this rule were dropped."""
    enforced = mask(POLICIES[version])
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(enforced)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).cast("long").alias("bit")) for name in POLICIES[version]])
    each = patterns.select("pattern", "n", F.explode(bits).alias("r")).select("pattern", "n", "r.*")
    failed = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", version: str = "v2") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    whole = docs.select(whole_row(docs).alias("_row"), F.col(text).alias("_text"))
    return apply_policy(ledger(whole, "_row", "_text"), version).where("kept").select("_row.*")


def query(spark, sf_dir):
    book = apply_policy(ledger(read_table(spark, sf_dir, "documents")))
    return book.withColumn("base_failed", rejected("base"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM places),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, """ + " | ".join(f"(CASE WHEN {condition} THEN {1 << place} ELSE 0 END)" for place, (_, condition) in enumerate(RULES)) + f""" AS failures FROM m)
SELECT *, failures & {mask(POLICIES["v2"])} = 0 AS kept, failures & {mask(POLICIES["base"])} <> 0 AS base_failed FROM f"""
