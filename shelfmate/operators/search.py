"""Title search: literal, case-insensitive substring match in catalogue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmate.operators.joins import splittable_join
from shelfmate.schemas import ITEM

MAX_LIMIT = 50
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    last = F.char_length(text) - n + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def title_index(catalogue: DataFrame) -> DataFrame:
    """(gram, item_idx): every run of one to three characters of every title, in lower case. Worth storing: searches
    then read lists instead of titles."""
    grams = F.concat(*[_grams(F.lower("title"), n) for n in range(1, GRAM + 1)])
    return catalogue.where(F.col("title").isNotNull()).select(F.explode(grams).alias("gram"), "item_idx")


def rarest_grams(asked: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each query (query, _low) the gram with the shortest list, ties by the gram, as (query, _low, gram, n); and the
    lists (gram, item_idx) of all grams of the queries.

    Grams have three characters, or as many as the query. A query with a gram that no title has gives no row.
    """
    size = F.least(F.char_length("_low"), F.lit(GRAM))
    runs = asked.withColumn("gram", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length("_low") - size + 1), lambda i: F.substring(F.col("_low"), i, size)
    ))))
    lists = index.join(runs.select("gram").distinct(), "gram", "left_semi")
    counts = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = runs.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("query", "_low").agg(F.min(F.struct("n", "gram")).alias("least"))
    return rarest.select("query", "_low", "least.gram", "least.n").where("n > 0"), lists


def search_titles(
    catalogue: DataFrame, queries: list[str] | DataFrame, limit: int = 10, index: DataFrame | None = None
) -> DataFrame:
    """(query, pos, asin, item_idx, title): the first ``limit`` matches of every query.

    ``queries`` is a table with a column ``query``, or a short list; ``index`` a stored ``title_index`` of the
    catalogue. A title can only match a query all of whose grams it has, so a query meets the titles on the list of its rarest
    gram; long lists are split by their size. ``instr`` then decides, taking ``%`` and ``_`` literally. Queries that
    are NULL or empty give no rows in a table and an error in a list.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if not isinstance(queries, DataFrame):
        if any(len(q) < 1 for q in queries):
            raise ValueError("a query must have at least one character")
        queries = catalogue.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    asked = queries.select("query").where(F.length("query") > 0).distinct().withColumn("_low", F.lower("query"))
    chosen, lists = rarest_grams(asked, title_index(catalogue) if index is None else index)
    found = splittable_join(lists, chosen, ["gram"], "inner").select("query", "_low", "item_idx")
    titled = catalogue.where(F.col("title").isNotNull()).select(ITEM, "item_idx", "title")
    met = splittable_join(found, titled, ["item_idx"], "inner").where(F.instr(F.lower("title"), F.col("_low")) > 0)
    order = W.partitionBy("query").orderBy("item_idx")
    return (
        met.withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= limit)
        .select("query", "pos", ITEM, "item_idx", "title")
    )
