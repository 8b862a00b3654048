"""JSON-lines sources: reviews and product metadata, whole or the first N lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.functions.columns import json_object, json_text, whole_number
from shelfmate.schemas import JOIN_KEY, RAW_REVIEW
from shelfmate.session import cut_lineage

# A metadata file is read three times as far as the review file when a limit is set.
METADATA_LINES_PER_REVIEW_LINE = 3


def shape_reviews(raw: DataFrame) -> DataFrame:
    """Raw review fields -> table names; the join key falls back to the item id."""
    return raw.select(
        F.col("user_id").alias("reviewerID"),
        F.col("asin"),
        F.col("rating"),
        F.col("text").alias("reviewText"),
        whole_number(F.col("timestamp")).alias("timestamp"),
        F.coalesce("parent_asin", "asin").alias(JOIN_KEY),
    )


def read_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reviews with an explicit schema; only the six fields are parsed, all as text.

    Lines that are no complete JSON object give no row, whatever the limit. With ``limit`` the first
    ``limit`` physical lines are taken before parsing, so malformed lines count towards it.
    """
    lines = spark.read.text(path) if limit is None else first_lines(spark, path, limit)
    trimmed = F.trim("value")
    schema = T.StructType([*RAW_REVIEW.fields, T.StructField("_malformed", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "allowSingleQuotes": "false"}
    parsed = lines.where(trimmed.startswith("{") & trimmed.endswith("}")).select(F.from_json("value", schema, options).alias("r"))
    return shape_reviews(parsed.select("r.*").where(F.col("_malformed").isNull()))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a sortable position: file, byte offset of the split, line in the split."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` physical lines in file order.

    A plain limit takes lines from whichever split answers first; ordering by position
    makes it a per-task top-n followed by a merge of at most n lines each.
    """
    return numbered_lines(spark, path).orderBy("position").limit(n)


def read_metadata(spark: SparkSession, path: str, limit: int | None = None, key_fallback: bool = False) -> DataFrame:
    """One row per product: key, title and category.

    ``limit`` is the review limit; three times as many metadata lines are read.
    ``key_fallback`` uses ``asin`` where a record has no ``parent_asin`` (the cache job).
    """
    if limit is not None:
        lines = first_lines(spark, path, METADATA_LINES_PER_REVIEW_LINE * limit)
    else:
        lines = numbered_lines(spark, path)
    parsed = lines.select(json_object(F.col("value")).alias("record"), "position").where(F.col("record").isNotNull())
    record = F.col("record")
    key = json_text(record, "parent_asin")
    if key_fallback:
        key = F.coalesce(key, json_text(record, "asin"))
    records = parsed.select(
        key.alias(JOIN_KEY),
        json_text(record, "title").alias("product_title"),
        json_text(record, "main_category").alias("main_category"),
        "position",
    )
    # Parsed once: the narrow records are stored before the two passes of first_per_key.
    records = cut_lineage(records.where(F.col(JOIN_KEY) != ""))
    return first_per_key(packed_position(records), JOIN_KEY, F.col("position"))


def packed_position(records: DataFrame) -> DataFrame:
    """``position`` as one number: place of the file by name, byte offset of the split, row of the task's read (33 bits).

    The table of file names is as long as Spark's own listing of them; whether it is broadcast is left to its size.
    """
    names = records.select(F.col("position.file").alias("_file")).distinct()
    names = names.withColumn("_place", F.row_number().over(W.orderBy("_file")).cast("decimal(10,0)"))
    offset = F.col("position.split").cast("decimal(14,0)")
    row = F.col("position.line").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)")
    place = F.col("_place") * F.lit(10**14).cast("decimal(15,0)") + offset
    packed = (place.cast("decimal(25,0)") * F.lit(10**10).cast("decimal(11,0)") + row).cast("decimal(38,0)")
    joined = records.join(names, F.col("position.file") == F.col("_file"))
    return joined.withColumn("position", packed).drop("_file", "_place")


def first_per_key(df: DataFrame, key: str, position: Column) -> DataFrame:
    """Keep the earliest row of every key. Positions are numbers, not NULL and distinct within a key.

    The least position of a key is a hash aggregate, whose copies collapse before the shuffle, so a key
    that fills a third of the file costs one number per task; a semi join by key and position, which no key
    makes hot, then fetches the rows. ``df`` is read twice.
    """
    least = df.groupBy(F.col(key).alias("_key")).agg(F.min(position).alias("_least"))
    first = df.join(least, F.col(key).eqNullSafe(F.col("_key")) & (position == F.col("_least")), "left_semi")
    return first.select(key, *[c for c in df.columns if c not in (key, "position")])


def write_metadata_cache(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Parse a metadata file once into a typed, deduplicated Parquet table."""
    read_metadata(spark, source, key_fallback=True).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
