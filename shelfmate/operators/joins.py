"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join whose skewed partitions adaptive execution is able to split.

    Spark splits a skewed partition only where both sides of the join come straight from a
    shuffle. A right side that was just aggregated by the join keys has no shuffle of its own
    any more: it is joined inside the aggregate's stage, and a hot key stays in one task.
    Joining on the keys and one bit of their hash asks for a partitioning the aggregate does not have, so
    its (narrow) result is shuffled once more and the skew join applies. (One bit, because a whole hash
    does not compress and every row carries it through the shuffle.) A small right
    side is still broadcast, by its measured size.
    """
    part = F.shiftrightunsigned(F.xxhash64(*keys), 63)
    joined = left.withColumn("_part", part).join(right.withColumn("_part", part), [*keys, "_part"], how)
    return joined.drop("_part")
