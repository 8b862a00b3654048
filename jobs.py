"""Command line of the batch jobs, for spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmate.plans import categories, evaluation
from shelfmate.plans.als_recommender import AlsParams, AlsRecommender
from shelfmate.plans.knn_recommender import KnnRecommender
from shelfmate.session import build_session
from shelfmate.sources import json_lines, tables


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("interactions", help="one category: JSON lines to the interaction table")
    job.add_argument("--source", required=True)
    job.add_argument("--meta")
    job.add_argument("--output", required=True)
    job.add_argument("--limit", type=int)

    job = jobs.add_parser("categories", help="all categories of a configuration file")
    job.add_argument("--config", required=True)
    job.add_argument("--dataset-dir", required=True)
    job.add_argument("--output-dir", required=True)
    job.add_argument("--limit", type=int)
    job.add_argument("--continue-on-error", action="store_true")

    job = jobs.add_parser("metadata-cache", help="metadata JSON lines to a deduplicated Parquet table")
    job.add_argument("--source", required=True)
    job.add_argument("--output", required=True)

    for name in ("train-knn", "train-als", "evaluate-knn", "evaluate-als"):
        job = jobs.add_parser(name)
        if name == "evaluate-knn":
            job.add_argument("--model", required=True, help="folder written by train-knn")
        else:
            job.add_argument("--path", required=True, nargs="+", help="interaction tables")
        job.add_argument("--output", required=True, help="model folder, or metrics folder when evaluating")
        if name.startswith("evaluate"):
            job.add_argument("--users", type=int, default=1000)
            job.add_argument("--min-history", type=int, default=5)
            job.add_argument("--ks", type=int, nargs="+", default=[5, 10, 20])
        if name == "evaluate-knn":
            job.add_argument("--max-history", type=int, default=0, help="0 keeps whole histories")
        if name.endswith("als"):
            for option in ("factors", "iterations", "regularization", "alpha", "min_rating"):
                default = getattr(AlsParams(), option)
                job.add_argument(f"--{option.replace('_', '-')}", type=type(default), default=default)
        job.add_argument("--seed", type=int, default=42)

    for name in ("recommend", "recommend-history", "search"):
        job = jobs.add_parser(name)
        job.add_argument("--model", required=True)
        job.add_argument("--kind", choices=["knn", "als"], default="knn")
        job.add_argument("--output", required=True)
        job.add_argument("--top-k", type=int, default=10)
        if name == "search":
            job.add_argument("--query", action="append", default=[])
            job.add_argument("--query-table", action="append", default=[], help="tables with a column query")
        elif name == "recommend":
            job.add_argument("--seed-table", required=True, action="append")
        else:
            job.add_argument("--history-table", required=True, action="append", help="tables (query, pos, asin)")
    return parser.parse_args()


def interaction_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    return tables.read_shards(spark, paths)


def als_params(a: argparse.Namespace) -> AlsParams:
    return AlsParams(a.factors, a.iterations, a.regularization, a.alpha, a.min_rating, a.seed)


def row_numbered(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """The interactions with the file and row they come from, which identify a row."""
    place = [F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_no")]
    groups = tables.files_by_schema(spark, paths)
    frames = {schema: spark.read.parquet(*files).select("*", *place) for schema, files in groups.items()}
    if not frames:
        raise ValueError("no shard matched")
    return tables.union_of_types(frames), ["row_file", "row_no"]


def main() -> None:
    a = arguments()
    spark = build_session(f"shelfmate-{a.job}")
    if a.job == "interactions":
        result = categories.run_category(spark, a.source, a.source, a.meta, a.output, a.limit)
        tables.write_report(spark, result, f"{a.output.rstrip('/')}_timings.json")
    elif a.job == "categories":
        summary = categories.run_categories(
            spark, a.config, a.dataset_dir, a.output_dir, a.limit, a.continue_on_error
        )
        if summary.where("status <> 'success'").count():
            raise SystemExit(1)
    elif a.job == "metadata-cache":
        json_lines.write_metadata_cache(spark, a.source, a.output)
    elif a.job == "train-knn":
        KnnRecommender.fit(interaction_tables(spark, a.path), a.output)
    elif a.job == "train-als":
        AlsRecommender.fit(interaction_tables(spark, a.path), a.output, als_params(a))
    elif a.job == "evaluate-knn":
        model = KnnRecommender.load(spark, a.model)
        report = evaluation.evaluate_knn(model, a.ks, a.users, a.min_history, a.max_history, a.seed)
        report.coalesce(1).write.mode("overwrite").json(a.output)
    elif a.job == "evaluate-als":
        frame, row_id = row_numbered(spark, a.path)
        report = evaluation.evaluate_als(
            frame, row_id, f"{a.output.rstrip('/')}_model", a.ks, als_params(a), a.users, a.min_history
        )
        report.coalesce(1).write.mode("overwrite").json(a.output)
    else:
        model = (KnnRecommender if a.kind == "knn" else AlsRecommender).load(spark, a.model)
        if a.job == "search":
            asked = spark.createDataFrame([(q,) for q in a.query], "query string")
            if a.query_table:
                asked = asked.unionByName(spark.read.parquet(*a.query_table).select("query"))
            found = model.search(asked, a.top_k)
        elif a.job == "recommend-history":
            histories = spark.read.parquet(*a.history_table)
            found = model.recommend_histories(histories, a.top_k) if a.kind == "knn" else model.recommend_item_histories(histories, a.top_k)
        else:
            seeds = spark.read.parquet(*a.seed_table).select("seed")
            found = model.recommend(seeds, a.top_k) if a.kind == "knn" else model.similar(seeds, a.top_k)
        found.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
