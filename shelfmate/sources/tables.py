"""Parquet sources and sinks of the interaction table, and the category configuration."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.functions.columns import safe_file_name, strict_number
from shelfmate.schemas import CATEGORY_CONFIG, INTERACTION_COLUMNS


def read_shards(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Concatenate interaction shards whose column types may differ: files, folders or globs, each of
    which may mix types.

    The files are listed by Spark and grouped by schema, whose footers are read by tasks; every group is one scan,
    and columns whose type differs between groups become text before the union. So the plan grows with the
    number of distinct schemas, not with the number of files.
    """
    groups = files_by_schema(spark, paths)
    if not groups:
        raise ValueError("no shard matched")
    return union_of_types(
        {schema: spark.read.parquet(*members) for schema, members in groups.items()}, columns
    )


def _footers(batches):
    """(file, its columns and types) for each file, read where Python can reach it; NULL elsewhere."""
    import json
    from urllib.parse import unquote, urlparse

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            parsed = urlparse(path)
            try:
                if parsed.scheme in ("", "file"):
                    schema = pq.read_schema(unquote(parsed.path))
                else:
                    system, inner = fs.FileSystem.from_uri(path)
                    with system.open_input_file(inner) as source:
                        schema = pq.read_schema(source)
                found.append(json.dumps([[f.name, str(f.type)] for f in schema]))
            except (OSError, ValueError, ImportError):
                found.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "schema"])


def files_by_schema(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Parquet files under the paths, grouped by schema. File names reach the driver, as for any scan. Files only
    Spark can open are asked for their schema through Spark, one by one."""
    if not paths:
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(paths)
    named = files.select("path").repartition(max(1, min(200, spark.sparkContext.defaultParallelism)))
    groups: dict[str, list[str]] = defaultdict(list)
    for path, schema in named.mapInArrow(_footers, "path string, schema string").collect():
        groups[schema or str(spark.read.parquet(path).dtypes)].append(path)
    return {schema: sorted(members) for schema, members in sorted(groups.items())}


def union_of_types(frames: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    types = defaultdict(set)
    for frame in frames.values():
        for name, dtype in frame.dtypes:
            types[name].add(dtype)
    parts = []
    for frame in frames.values():
        wanted = [name for name in frame.columns if columns is None or name in columns]
        parts.append(
            frame.select([F.col(n).cast("string").alias(n) if len(types[n]) > 1 else F.col(n) for n in wanted])
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def interaction_columns(df: DataFrame, leading: list[str] | None = None) -> DataFrame:
    """The seven columns in order, after any ``leading`` ones; those that do not exist (no
    metadata given) are NULL. The rating becomes a number, NULL where it is none; the row stays."""
    if "rating" in df.columns:
        rating = F.col("rating")
        text = isinstance(df.schema["rating"].dataType, T.StringType)
        df = df.withColumn("rating", strict_number(rating) if text else rating.cast("double"))
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in INTERACTION_COLUMNS]
    return df.select(*(leading or []), *columns)


def write_interactions(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = interaction_columns(df, [partition_by] if partition_by else None).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_category_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured category with its files, a safe file name and a validity flag."""
    config = spark.read.schema(CATEGORY_CONFIG).option("multiLine", True).json(path)
    fields = ["name", "review_file", "meta_file"]
    complete = F.lit(True)
    for field in fields:
        complete = complete & (F.coalesce(F.col(field), F.lit("")) != "")
    return (
        config.select(F.posexplode("categories").alias("position", "c"))
        .select("position", *[F.col(f"c.{f}").alias(f) for f in fields])
        .select("position", *fields, safe_file_name(F.col("name")).alias("safe_name"), complete.alias("is_valid"))
    )


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small run document as one JSON line."""
    flat = {k: v for k, v in report.items() if v is not None}
    spark.createDataFrame([flat]).coalesce(1).write.mode("overwrite").json(path)
