"""Size figures of an interaction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.schemas import ITEM, USER


def dataset_profile(df: DataFrame, min_history: int = 5, user: str = USER, item: str = ITEM) -> DataFrame:
    """(metric, value): rows, users, items, distinct pairs, eligible users.

    Several distinct counts in one aggregate would multiply every row; here the rows collapse
    once into (user, item) cells, and each figure is a small aggregate of these.
    """
    cells = (
        df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
        .groupBy(user, item)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_user = cells.groupBy(user).agg(F.sum("n").alias("n"))
    per_item = cells.groupBy(item).agg(F.sum("n").alias("n"))

    def figures(frame: DataFrame, **columns) -> DataFrame:
        named = [F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in columns.items()]
        return frame.agg(F.array(*named).alias("f")).select(F.explode("f").alias("f")).select("f.*")

    parts = [
        figures(cells, n_interactions=F.coalesce(F.sum("n"), F.lit(0)), n_pairs=F.count(F.lit(1))),
        figures(per_user, n_users=F.count(F.lit(1)), n_eligible_users=F.count_if(F.col("n") >= min_history)),
        figures(per_item, n_items=F.count(F.lit(1))),
    ]
    return reduce(DataFrame.unionByName, parts)
