"""Exact deduplication that stays balanced under hot texts, with DataFrame functions only.

Texts are equal when they are identical after deleting white space ``[\\x20\\x09-\\x0D]``. Copies are
combined in three steps, and every step groups by the whole normalised text beside its digest:

1. locally: the map side of the first aggregation merges the copies a task has read;
2. salted: digests with more than one row in a thousand are spread over salts, so that a
   text owning a third of all rows is merged by many tasks;
3. globally: the winners of the salts are combined, again by the whole text. Only hot digests have several salts; the texts
   of all others have met in step 2 and travel no further.

Documents are then matched with their group by digest and a 64-bit hash, without texts; two contents under one such pair
would end the run with an error rather than be taken for copies.

There are fewer than 1000 hot digests whatever the input, so their list is broadcast.

Defined results: a null text counts as empty, and all empty texts are copies of each other. Of equal
texts the row with the most code points in the original text stays, then the smallest doc_id; a null
doc_id is the largest. Rows that agree in doc_id, normalised text and length are copies too: one
of them is marked as kept. An empty table gives no rows. Only the key and text columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmate.llm.common import WHITE, read_table, row_hash, through_table, whole_row

#: A digest is hot when it has more than this share of the rows.
HOT_SHARE = 0.001
SALTS = 64

#: Winners are compared as one number: length * 2^65 + (2^63 - doc_id), 0 in place of a null doc_id's part.
_BASE = "36893488147419103232"
_TOP = "9223372036854775808"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", "")


def _dec(value: str) -> Column:
    return F.lit(value).cast("decimal(38,0)")


def _packed(chars: Column, key: Column) -> Column:
    part = F.coalesce(_dec(_TOP) - key.cast("decimal(20,0)"), _dec("0"))
    return (chars.cast("decimal(10,0)") * _dec(_BASE) + part).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, keep_id, group_size, kept, text_sha256, chars, variant.

    The key must be a whole number. ``variant`` tells apart different texts of one digest.
    """
    body = normalised(F.col(text))
    rows = docs.select(
        F.col(key).cast("long").alias("_key"),
        F.sha2(body, 256).alias("_sha"),
        F.xxhash64(body).alias("_variant"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_chars"),
        body.alias("_body"),
    )
    narrow = through_table(rows.drop("_body"), "exact-digests")
    total = narrow.count()
    hot = (
        narrow.groupBy("_sha")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > F.lit(max(1.0, total * HOT_SHARE)))
        .select("_sha", F.lit(True).alias("_hot"))
    )
    salted = (
        rows.join(F.broadcast(hot), "_sha", "left")
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_key", "_chars"), F.lit(SALTS))).otherwise(F.lit(0)))
    )
    best = _packed(F.col("_chars"), F.col("_key"))
    merged = salted.groupBy("_sha", "_variant", "_salt", "_hot", "_body").agg(
        F.max(best).alias("_best"), F.count(F.lit(1)).alias("_n")
    )
    contents = merged.where("_hot").groupBy("_sha", "_variant", "_body").agg(
        F.max("_best").alias("_best"), F.sum("_n").alias("group_size"), F.max("_hot").alias("_hot")
    )
    single = merged.where("not _hot").select("_sha", "_variant", "_body", "_best", F.col("_n").alias("group_size"), "_hot")
    contents = contents.unionByName(single)
    one = F.when(F.count(F.lit(1)) == 1, F.max("_best")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("decimal(38,0)"))
    groups = contents.groupBy("_sha", "_variant").agg(
        one.alias("_best"), F.max("group_size").alias("group_size"), F.max("_hot").alias("_hot")
    )
    part = F.col("_best") % _dec(_BASE)
    winners = groups.select(
        "_sha",
        "_variant",
        "group_size",
        "_hot",
        F.when(part != 0, (_dec(_TOP) - part).cast("long")).alias("keep_id"),
        F.floor((F.col("_best") - part) / _dec(_BASE)).cast("long").alias("_keep_chars"),
    )
    # A hot digest's rows meet one winner: by hash and salt, each winner repeated for every salt.
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    winners = winners.withColumn("_salt", F.explode(salts)).drop("_hot")
    members = (
        narrow.groupBy("_sha", "_variant", "_key", "_chars")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .join(F.broadcast(hot), "_sha", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_key", "_chars"), F.lit(SALTS))).otherwise(F.lit(0)))
        .join(winners, ["_sha", "_variant", "_salt"])
        .withColumn("_place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    )
    stays = F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("_keep_chars")) & (F.col("_place") == 1)
    return members.select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        stays.alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_chars").alias("chars"),
        F.col("_variant").alias("variant"),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs, key, text).where("kept").select(
        F.col(key).alias("_key"), F.col("text_sha256").alias("_sha"), F.col("chars").alias("_chars")
    )
    rows = docs.select(
        whole_row(docs).alias("_row"),
        row_hash(docs).alias("_hash"),
        F.col(key).cast("long").alias("_key"),
        F.sha2(normalised(F.col(text)), 256).alias("_sha"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_chars"),
    )
    joined = rows.alias("r").join(
        kept.alias("k"),
        F.col("r._key").eqNullSafe(F.col("k._key")) & (F.col("r._sha") == F.col("k._sha")) & (F.col("r._chars") == F.col("k._chars")),
        "left_semi",
    )
    # Rows repeated in key and text: any one of them. The window has the join's own keys.
    first = F.row_number().over(Window.partitionBy("_key", "_sha", "_chars").orderBy("_hash"))
    return joined.withColumn("_first", first).where("_first = 1").select("_row.*")


def query(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents")).drop("chars", "variant")


ORACLE = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
k AS (SELECT body, count(*) AS group_size, arg_max(doc_id, [chars, -doc_id]) AS keep_id FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN k USING (body)"""
