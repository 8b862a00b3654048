"""The test tables in the shape of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that identify one interaction row.
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews: customer, part, a 1..5 rating from the quantity, order time."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("l_partkey").cast("string").alias("asin"),
        (1.0 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("reviewText"),
        # Order times carry no zone, so the difference does not depend on the session's.
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("timestamp"),
        F.col("l_partkey").cast("string").alias("parent_asin"),
        *ROW_ID,
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted parts have no metadata, so that a left join has rows without a match."""
    return table(spark, sf_dir, "part").where(F.col("p_type") != "PROMO").select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("product_title"),
        F.col("p_type").alias("main_category"),
    )


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: the item is the number in the JSON properties."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("reviewerID"),
        F.get_json_object("props", "$.k").alias("asin"),
        F.col("event_type").alias("category"),
        F.col("value"),
    )
