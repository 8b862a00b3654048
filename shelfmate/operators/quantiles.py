"""Exact interpolated percentiles of a column of any size."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmate.session import scratch_path

# Distinct values ranked in one task, about.
VALUES_PER_BUCKET = 100_000


def value_summary(df: DataFrame, column: str, percentiles: list[float], buckets: int | None = None) -> DataFrame:
    """One row: n, mean, min, max and the percentiles (0..100), linearly interpolated.

    The built-in exact percentile keeps every distinct value in one task. Here equal values
    collapse first, the distinct values are cut at approximate quantiles into buckets of
    similar size, each bucket is ranked on its own, and a running sum over the bucket
    sizes turns places into global ranks. The number of buckets follows the number of distinct values; the counted
    values are written once.
    """
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counts = rows.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    path = scratch_path(df.sparkSession, "values")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    buckets = buckets or max(16, -(-counts.count() // VALUES_PER_BUCKET))
    cuts = sorted(set(counts.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="v", outputCol="bucket").transform(counts)

    sizes = placed.groupBy("bucket").agg(F.sum("c").alias("size"))
    everything = W.partitionBy(F.lit(0))
    starts = sizes.select(
        "bucket",
        F.coalesce(F.sum("size").over(everything.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
            "start"
        ),
        F.sum("size").over(everything).alias("n"),
    )
    upto = W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        placed.withColumn("upto", F.sum("c").over(upto))
        .join(starts, "bucket")
        .select("v", "c", "n", (F.col("start") + F.col("upto")).alias("end"))
        .withColumn("begin", F.col("end") - F.col("c"))
    )

    # Zero-based position of a percentile and the two sorted values around it.
    columns = [
        F.max("n").alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    ]
    for p in percentiles:
        position = (F.col("n") - 1) * F.lit(p / 100.0)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("begin") <= at) & (at < F.col("end"))
            columns.append(F.max(F.when(holds, F.col("v"))).alias(f"{side}_{_name(p)}"))
    totals = ranked.agg(*columns)

    def interpolated(p: float):
        position = (F.col("n") - 1) * F.lit(p / 100.0)
        low, high = F.col(f"lo_{_name(p)}"), F.col(f"hi_{_name(p)}")
        return (low + (high - low) * (position - F.floor(position))).alias(f"p{_name(p)}")

    return totals.select("n", "mean", "min", "max", *[interpolated(p) for p in percentiles])


def _name(p: float) -> str:
    return f"{p:g}".replace(".", "_")


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, p95, p99, min and max of a latency column."""
    return value_summary(df, column, [50, 95, 99]).withColumnRenamed("p50", "median")
