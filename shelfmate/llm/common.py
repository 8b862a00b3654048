"""What several operators of this package share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmate.session import scratch_path, ship_package

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"


#: Rows handed to a Python worker at a time. Documents are long, so far fewer than Spark's default: the batch is held by
#: the JVM and the worker both.
ROWS_PER_BATCH = 500


def prepare(spark: SparkSession) -> None:
    """Before tasks run Python over texts: the package is on the executors, and batches are small."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > ROWS_PER_BATCH:
        spark.conf.set(setting, ROWS_PER_BATCH)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: computed once, and a lost
    executor costs no recomputation of what came before."""
    prepare(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A number that follows from a row's values, to choose among rows that agree in all that matters."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in df.dtypes if not re.search("map<|variant", kind)])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
