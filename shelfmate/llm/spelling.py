"""Spelling variants: words one edit apart, found through permuterm rotations.

A word is closed by a terminator, and all its rotations go into one sorted index. The rotation that begins
behind a character and runs round to it is ``behind $ before character``, so all words that differ in that one character
share the rotation but for its last character, and the word that lacks the character is that prefix itself. An edit is
therefore a prefix of a rotation, the edited character skipped:

- rotations that differ in the skipped last character only belong to words one replacement apart;
- a whole rotation equal to the prefix belongs to the word one deletion away (and the others to its insertions).

The index is sorted by the prefix over range partitions, and one scan of each group of equal prefixes gives every
member the number of its neighbours there and the most frequent of them. Pairs are never rows. A group
has one member per letter and one whole rotation, so it is bounded by the alphabet, whatever the corpus. A
pair of words meets in exactly one group: a character of a run of equal ones can be left out at any place of the run, and only the
first place counts.

Forms have at least ``ratio`` times the count of their variant, so following them ends after log_ratio(largest count)
steps; roots come from pointer doubling over the words that have a form, each round a table in the shared folder.

Defined results: a null or empty text has no words; a null key enters the hash as an empty text. Repeated rows count each.
Of near words of equal count the first in code-point order is the form. An empty table gives no rows. Only the key and
text columns are read, so other columns cannot clash. Letters are ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmate.llm.common import read_table, through_table
from shelfmate.operators.joins import splittable_join

LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a word; no letter.
END = "$"
SHORTEST, FEWEST, RATIO = 6, 5, 5
#: One run in so many (per key and run) loses a character, so that the table has misspellings.
SLIP = 199


def slipped(run: Column, key: Column) -> Column:
    """The run without one code point where the hash of key and run says so."""
    hashed = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (hashed % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(hashed % SLIP == 0, shorter).otherwise(run)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: bool = False, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least ``shortest`` code points and ``fewest`` occurrences.

    ``slip`` damages some runs by ``slipped`` first.
    """
    # A run shortened by a slip still has to reach the shortest length, so shorter runs cannot matter.
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS[:-1]}{{{shortest},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_key", F.translate("_run", CAPITALS, SMALL).alias("_run"))
    if slip:
        runs = runs.select(slipped(F.col("_run"), F.col("_key")).alias("_run"))
    counted = runs.where(F.char_length("_run") >= shortest).groupBy(F.col("_run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= fewest)


def permuterm(words: DataFrame) -> DataFrame:
    """The sorted index of ``words`` (word, n): (prefix, whole, first, word, n).

    ``whole`` marks a rotation taken whole; otherwise its last character is skipped, and ``first`` tells that this
    character is the first of its run of equal characters.
    """
    closed, length = F.concat("word", F.lit(END)), F.char_length("word")
    rotations = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("_at"), closed.alias("_closed"), length.alias("_length"))
    # The rotation that begins at the code point _at (from 0); its last code point is the one before.
    behind = F.substring("_closed", F.col("_at") + 1, F.col("_length") + 1)
    whole = F.concat(behind, F.substring("_closed", F.lit(1), F.col("_at")))
    skipped = F.concat(behind, F.substring("_closed", F.lit(1), F.col("_at") - 1))
    last, before = F.substring("word", F.col("_at"), F.lit(1)), F.substring("word", F.col("_at") - 1, F.lit(1))
    first = (F.col("_at") == 1) | (last != before)
    entries = F.array(
        F.struct(whole.alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first")),
        # Rotation 0 ends with the terminator, which no edit can change.
        F.when(F.col("_at") > 0, F.struct(skipped.alias("prefix"), F.lit(False).alias("whole"), first.alias("first"))),
    )
    index = rotations.select("word", "n", F.explode(entries).alias("_e")).where("_e IS NOT NULL").select("_e.*", "word", "n")
    return index.repartitionByRange("prefix").sortWithinPartitions("prefix")


def scan_groups(index: DataFrame) -> DataFrame:
    """(word, n_near, best): per word and group, the neighbours met there and the best of them, struct(minus n, word)."""
    group = Window.partitionBy("prefix")
    ranked = group.orderBy("whole", F.desc("n"), "word")
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    skips = ~F.col("whole")
    met = index.withColumn("_me", me).select(
        "word", "whole", "first",
        F.row_number().over(ranked).alias("_place"),
        F.sum(skips.cast("long")).over(group).alias("_skips"),
        F.sum((skips & F.col("first")).cast("long")).over(group).alias("_firsts"),
        F.min(F.when(F.col("whole"), F.col("_me"))).over(group).alias("_whole"),
        F.min(F.when(skips & F.col("first"), F.col("_me"))).over(group).alias("_inserted"),
        F.first(F.when(skips, F.col("_me"))).over(every).alias("_one"),
        F.nth_value(F.when(skips, F.col("_me")), 2).over(every).alias("_two"),
    )
    shorter = F.when(F.col("first"), F.col("_whole"))
    replaced = F.when(F.col("_place") == 1, F.col("_two")).otherwise(F.col("_one"))
    near = F.when(F.col("whole"), F.col("_firsts")).otherwise(F.col("_skips") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(F.col("whole"), F.col("_inserted")).otherwise(F.least(replaced, shorter))
    return met.select("word", near.alias("n_near"), best.alias("best")).where("n_near > 0")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form), following forms to the last."""
    state = through_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = splittable_join(state, onward, ["root"], "left")
        after = through_table(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        state = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return state


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; words distinct).

    Near words differ by exactly one code point inserted, deleted or replaced. A word's form is its near word of largest n,
    if that is at least ``ratio`` (above 1) times the word's own.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could go round in circles")
    words = through_table(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = scan_groups(permuterm(words)).select("word", "n_near", F.col("best.word").alias("_best"), (-F.col("best.minus_n")).alias("_best_n"))
    # The best neighbour over a word's groups: the largest count by hash aggregate, then the smallest word that has it.
    each = through_table(near, "spelling-near")
    top = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("_best_n").alias("_best_n"))
    best = each.join(top.select("word", "_best_n"), ["word", "_best_n"]).groupBy("word").agg(F.min("_best").alias("_best"))
    found = words.join(top, "word", "left").join(best, "word", "left")
    strong = F.col("_best_n") >= ratio * F.col("n")
    found = through_table(
        found.select("word", F.when(strong, F.col("_best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("_best_n")).alias("form_n")),
        "spelling-forms",
    )
    roots = follow(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return spelling_variants(count_words(read_table(spark, sf_dir, "documents"), slip=True))


_CRC = (
    "xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), "
    "lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [(192 + unicode(x) // 64)::UBIGINT, (128 + unicode(x) % 64)::UBIGINT] END)), "
    "lambda c, b: list_reduce([xor(c, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], "
    "lambda v, u: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"
)

ORACLE = rf"""WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
  '{CAPITALS}', '{SMALL}') AS run FROM documents),
counts AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, c, {_CRC} AS h FROM counts),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, word[:i - 1] || '_' || word[i + 1:] AS replaced, word[:i - 1] || word[i + 1:] AS deleted FROM places),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT DISTINCT h.word, w.word, w.n FROM holes h JOIN words w ON h.deleted = w.word
  UNION SELECT DISTINCT w.word, h.word, h.n FROM holes h JOIN words w ON h.deleted = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at_word, 0 AS steps FROM formed
  UNION ALL SELECT walk.word, formed.form, steps + 1 FROM walk JOIN formed ON walk.at_word = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(at_word, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
