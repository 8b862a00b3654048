"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.llm.common import through_table
from shelfmate.operators.joins import splittable_join


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour is linked to the node's smallest neighbour. Small star: the node and
    its smaller neighbours are. The join splits a node with very many neighbours."""
    if large:
        seen = _both_ways(edges)
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
    joined = splittable_join(seen, least, ["a"], "inner")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionAll(least.select("a", F.col("_m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Alternates large and small stars until nothing changes (Kiveris et al., Connected Components in MapReduce
    and Beyond, 2014): a number of rounds that grows with the logarithm of the longest chain. Every
    round is written to the shared folder. No links give no rows.
    """
    edges = through_table(edges.select("a", "b").where("a <> b").distinct(), "links")
    state = _state(edges)
    while True:
        starred = through_table(_star(edges, large=True), "links-large")
        edges = through_table(_star(starred, large=False), "links-small")
        now = _state(edges)
        if now == state:
            break
        state = now
    # The small star leaves (node, root) for every node but the roots.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
