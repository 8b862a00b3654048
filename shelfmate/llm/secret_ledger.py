"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

A history is a table of paths and texts: every version of a document is a row. A text's address is its SHA-256, so
versions and copies of one content are one blob. ``SecretLedger`` is a folder of Parquet batches that only grows:

- ``commit`` finds the blobs of a history that some rule has not seen in its present version, scans each of them once
  for just those rules, and appends one row per blob: its address, the rule versions that were run, the spans found;
- ``findings`` joins the spans of the present rule versions back to every row of a history.

So a new version of a document costs one scan, a copy none, and a changed rule is run alone over the old blobs. Copies
are merged by the map side of the aggregation that makes blobs, which compares whole texts, so a hot text crosses the shuffle once
per task; the join back is one whose hot keys adaptive execution splits. While the ledger is not empty, the unseen
addresses are worked out from the narrow digests first, and only their texts are moved.

A span is that of the whole match in code points, end exclusive. Matches are leftmost and do not overlap per rule; where a rule asks for a
number of characters that its pattern cannot, the shorter matches are dropped after matching. Offsets are running sums of
the lengths between and in the matches, taken in blocks, so a text of very many matches stays nearly linear.

Defined results: a null text counts as empty and has no spans. Repeated rows get a row each. An empty table gives no
rows. The key may be null or repeat. Only the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmate.llm.common import read_table
from shelfmate.operators.joins import splittable_join
from shelfmate.session import scratch_path


def either_case(pattern: str) -> str:
    """The pattern with a class of both cases in place of every letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


@dataclass(frozen=True)
class Rule:
    """``least`` is the number of characters asked of ``group`` after matching; 0 asks nothing."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Append only: a kind's place decides the order of spans that start together. Give a rule a new version when its pattern changes.
#: Where nothing but a run's length is asked, the pattern asks it itself: a shorter run has no longer one inside.
RULES = (
    Rule("assign", 1, f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", 1, "[0-9a-f]{16,}", base=True),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", 1, "(?:gh[oprsu]_|glpat-|xox[abprs]-|[rs]k_live_|AIza)[A-Za-z0-9_-]{16,}"),
    Rule("login", 1, "://[^\\x20\\x09-\\x0D:/@]+:[^\\x20\\x09-\\x0D:/@]+@"),
)

#: Matches whose offsets are added up together.
BLOCK = 256
_SPAN = "struct<start:bigint,place:int,stop:bigint,kind:string>"
_LEDGER = f"blob binary, scanned array<string>, spans array<{_SPAN}>"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _offsets(hits: Column, pieces: Column, groups: Column, rule: Rule, place: int) -> Column:
    """Spans of the matches ``hits`` that lie between ``pieces``."""
    total = F.size(hits)
    steps = F.transform(
        hits,
        lambda hit, i: F.struct(
            F.char_length(F.get(pieces, i)).cast("bigint").alias("gap"),
            F.char_length(hit).cast("bigint").alias("length"),
            (F.char_length(F.get(groups, i)) >= rule.least).alias("enough"),
        ),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((total - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda at, s: at + s["gap"] + s["length"]))

    def within(block: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0).cast("bigint"), lambda at, s: at + s)

        def add(state: Column, step: Column) -> Column:
            start = state["at"] + step["gap"]
            stop = start + step["length"]
            span = F.struct(start.alias("start"), F.lit(place).alias("place"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
            found = F.when(step["enough"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct(stop.alias("at"), found.alias("spans"))

        nothing = F.struct(before.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
        return F.aggregate(block, nothing, add, lambda state: state["spans"])

    return F.flatten(F.transform(blocks, within))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blobs`` (blob, text, todo): each blob by the rules whose names are in ``todo``."""
    none = F.array().cast(f"array<{_SPAN}>")
    wanted = [F.array_contains("todo", rule.name) & F.rlike("text", F.lit(rule.pattern)) for rule in rules]
    # Matches, texts between them and groups once per rule; then offsets, only where there are matches.
    matched = blobs.select(
        "blob",
        "todo",
        *[
            F.when(
                asked,
                F.struct(
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hits"),
                    F.split("text", rule.pattern, -1).alias("pieces"),
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("groups"),
                ),
            ).alias(f"_{place}")
            for place, (rule, asked) in enumerate(zip(rules, wanted))
        ],
    )
    spans = [
        F.when(F.col(f"_{place}").isNotNull(), _offsets(F.col(f"_{place}.hits"), F.col(f"_{place}.pieces"), F.col(f"_{place}.groups"), rule, place)).otherwise(none)
        for place, rule in enumerate(rules)
    ]
    return matched.select("blob", F.col("todo").alias("scanned"), F.array_sort(F.concat(*spans)).cast(f"array<{_SPAN}>").alias("spans"))


class SecretLedger:
    """What has been scanned, and what was found, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(_LEDGER).parquet(self.folder)
        return self.spark.createDataFrame([], _LEDGER)

    def unseen(self, history: DataFrame, text: str, rules=RULES) -> DataFrame:
        """(blob, text, todo): every content of the history once, with the rule versions still to be run on it."""
        names = F.array(*[F.lit(rule.name) for rule in rules])
        addressed = history.select(address(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
        known = self.rows()
        if known.isEmpty():
            pending = addressed.withColumn("todo", names)
        else:
            seen = known.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("_seen"))
            narrow = addressed.select("blob").distinct().join(seen, "blob", "left")
            todo = F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))
            left = narrow.select("blob", todo.alias("todo")).where(F.size("todo") > 0)
            pending = splittable_join(addressed, left, ["blob"], "inner")
        return pending.groupBy("blob", "text", "todo").agg(F.count(F.lit(1)).alias("_copies")).drop("_copies")

    def commit(self, history: DataFrame, text: str = "text", rules=RULES) -> None:
        scan(self.unseen(history, text, rules), rules).write.mode("append").parquet(self.folder)

    def findings(self, history: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
        """The history's rows without the text, each with ``spans`` of the present rule versions, by start and rule."""
        names = F.array(*[F.lit(rule.name) for rule in rules])
        current = self.rows().where(F.size("spans") > 0).select("blob", "spans", F.array_intersect("scanned", names).alias("_run"))
        # Spans of a row belong to the versions it ran: keep the kinds that are still current there.
        kinds = F.transform("_run", lambda name: F.substring_index(name, "@", 1))
        current = current.select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])).alias("spans"))
        found = current.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("_spans"))
        paths = history.withColumn("_blob", address(F.col(text))).drop(text)
        joined = splittable_join(paths, found.withColumnRenamed("blob", "_blob"), ["_blob"], "left")
        return joined.withColumn("spans", F.coalesce("_spans", F.array().cast(f"array<{_SPAN}>"))).drop("_spans", "_blob")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _equals(value: str):
    return lambda kind: kind == value


def query(spark, sf_dir):
    history = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = SecretLedger(spark, scratch_path(spark, "secret-ledger"))
    ledger.commit(history)
    places = {rule.kind: place for place, rule in enumerate(RULES) if rule.base}
    rows = ledger.findings(history).withColumn("_base", F.filter("spans", lambda s: s["place"].isin(*places.values())))
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(kind))).cast("long").alias(f"n_{kind}") for kind in places]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matched(place: int, rule: Rule) -> str:
    pattern = _sql(rule.pattern)
    return (
        f"SELECT r, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, {pattern}) AS h, "
        f"string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}, {rule.group}) AS g FROM d WHERE regexp_matches(text, {pattern})"
    )


_COUNTS = ", ".join(f"count(*) FILTER (place = {place}) AS n_{rule.kind}" for place, rule in enumerate(RULES) if rule.base)

ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(_matched(place, rule) for place, rule in enumerate(RULES))}),
each AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM matched),
spans AS (SELECT r, place, kind, length(h[i]) AS size, list_sum(list_transform(p[:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) AS start FROM each WHERE length(g[i]) >= least),
named AS (SELECT r, place, start, concat(kind, ':', start::BIGINT, ':', (start + size)::BIGINT) AS name FROM spans),
found AS (SELECT r, {_COUNTS}, coalesce(string_agg(name, ',' ORDER BY start, place) FILTER (place < 3), '') AS base,
  string_agg(name, ',' ORDER BY start, place) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (r)"""
