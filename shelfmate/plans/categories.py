"""From review and metadata files to the interaction table, one category or many."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmate.operators.cleaning import MIN_REVIEWS_PER_ITEM, MIN_REVIEWS_PER_USER, core_filter, join_metadata
from shelfmate.sources.json_lines import read_metadata, read_reviews
from shelfmate.sources.tables import interaction_columns, read_category_config, write_interactions, write_report

SUMMARY_SCHEMA = (
    "position int, category string, status string, parquet_path string, "
    "n_rows long, load_s double, filter_s double, to_parquet_s double, total_s double, error string"
)


def build_interactions(
    reviews: DataFrame,
    metadata: DataFrame | None,
    min_user: int = MIN_REVIEWS_PER_USER,
    min_item: int = MIN_REVIEWS_PER_ITEM,
    scope: list[str] | None = None,
) -> DataFrame:
    """Filter first, join after: metadata has one row per key, so the join changes no
    count, and only surviving reviews carry the titles through it."""
    kept = core_filter(reviews, min_user, min_item, scope=scope)
    if metadata is not None:
        shared = [c for c in (scope or []) if c in metadata.columns]
        kept = join_metadata(kept, metadata, [*shared, "parent_asin"])
    return interaction_columns(kept, scope)


def run_category(
    spark: SparkSession, name: str, review_path: str, meta_path: str | None, parquet_path: str, limit: int | None = None
) -> dict:
    """One category: load, filter, write. Only the write runs a job, so its time holds the work and the other two
    are near zero; the rows are counted on their way into the table."""
    started = time.perf_counter()
    reviews = read_reviews(spark, review_path, limit)
    metadata = read_metadata(spark, meta_path, limit) if meta_path else None
    loaded = time.perf_counter()
    table = build_interactions(reviews, metadata)
    filtered = time.perf_counter()
    counted = Observation()
    write_interactions(table.observe(counted, F.count(F.lit(1)).alias("n_rows")), parquet_path)
    written = time.perf_counter()
    return {
        "category": name,
        "status": "success",
        "parquet_path": parquet_path,
        "n_rows": counted.get["n_rows"],
        "load_s": loaded - started,
        "filter_s": filtered - loaded,
        "to_parquet_s": written - filtered,
        "total_s": written - started,
    }


def run_categories(
    spark: SparkSession,
    config_path: str,
    dataset_dir: str,
    output_dir: str,
    limit: int | None = None,
    continue_on_error: bool = False,
) -> DataFrame:
    """One Parquet table and one timing report per configured category, and a summary.

    The loop runs over the configuration, a handful of rows, so that one broken category
    does not take the others with it; each step of it is a whole Spark job.
    """
    summary = []
    for entry in read_category_config(spark, config_path).orderBy("position").collect():
        try:
            if not entry.is_valid:
                raise ValueError("a category needs name, review_file and meta_file")
            result = run_category(
                spark,
                entry["name"],
                f"{dataset_dir}/{entry.review_file}",
                f"{dataset_dir}/{entry.meta_file}",
                f"{output_dir}/dev_{entry.safe_name}.parquet",
                limit,
            )
            write_report(spark, {**result, "limit": limit}, f"{output_dir}/timings_{entry.safe_name}.json")
        except Exception as error:  # reported per category
            result = {"category": entry["name"], "status": "failed", "error": str(error).splitlines()[0]}
        summary.append({"position": entry.position, **result})
        if result["status"] == "failed" and not continue_on_error:
            break
    columns = [c.split(" ")[0] for c in SUMMARY_SCHEMA.split(", ")]
    report = spark.createDataFrame([tuple(row.get(c) for c in columns) for row in summary], SUMMARY_SCHEMA)
    report.coalesce(1).write.mode("overwrite").json(f"{output_dir}/timings_multi_summary.json")
    return report


def build_all_categories(reviews: DataFrame, metadata: DataFrame | None, **thresholds) -> DataFrame:
    """All categories in one plan: ``reviews`` (and ``metadata``) carry a ``category`` column and
    every count is taken within it. Write the result with ``partition_by="category"``."""
    return build_interactions(reviews, metadata, scope=["category"], **thresholds)


def stage_totals(timings: DataFrame) -> DataFrame:
    """(category, total_s) from rows (category, stage, seconds)."""
    return timings.groupBy("category").agg(F.sum("seconds").alias("total_s"))
