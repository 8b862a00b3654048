"""Integer codes for users and items, and the product catalogue."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmate.schemas import ITEM, UNKNOWN_TITLE
from shelfmate.session import scratch_path

KEYS_PER_BUCKET = 100_000


def distinct_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Distinct non-null keys over several shards; each shard is thinned before the union."""
    parts = [f.where(F.col(key).isNotNull()).select(key).distinct() for f in frames]
    return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]


def dense_codes(keys: DataFrame, key: str, code: str) -> DataFrame:
    """Codes 0..n-1 for a column of distinct keys, ordered by the MD5 of the key. Other
    columns are kept.

    Numbering in hash order needs no global sort: keys fall evenly into hash buckets of about KEYS_PER_BUCKET,
    each bucket is numbered on its own, and its start is a running sum over the
    bucket sizes. The order depends on the keys alone, not on the partitioning. The keys are written
    once, so what they are derived from is evaluated once.
    """
    path = scratch_path(keys.sparkSession, "keys")
    keys.write.parquet(path)
    keys = keys.sparkSession.read.schema(keys.schema).parquet(path)
    digits = max(1, math.ceil(math.log(max(1, keys.count() / KEYS_PER_BUCKET), 16)))
    hashed = keys.withColumn("h", F.md5(F.col(key).cast("string"))).withColumn("bucket", F.substring("h", 1, digits))
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per KEYS_PER_BUCKET / 16 keys at most; left to Spark's size check.
    before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("h", key)) - 1
    return (
        hashed.withColumn("place", place)
        .join(starts, "bucket")
        .select(*keys.columns, (F.col("start") + F.col("place")).cast("int").alias(code))
    )


def item_titles(df: DataFrame, item: str = ITEM, title: str = "product_title") -> DataFrame:
    """One title per item. Where an item has several, the smallest one is taken: unlike the
    first one met, it does not depend on the order of files. Equal (item, title) rows collapse by hash
    first, as a minimum of texts would sort all rows."""
    named = df.where(F.col(item).isNotNull()).select(item, F.col(title).alias("title")).distinct()
    return named.groupBy(item).agg(F.min("title").alias("title"))


def build_catalogue(df: DataFrame, item: str = ITEM, title: str = "product_title") -> DataFrame:
    """One row per item: key, code and title."""
    return dense_codes(item_titles(df, item, title), item, "item_idx").select(item, "item_idx", "title")


def title_or_default(title="title"):
    return F.coalesce(F.col(title), F.lit(UNKNOWN_TITLE))


def encode(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Attach the code of ``key``; rows with a NULL or unknown key drop out."""
    return df.join(ids, key, "inner")
