"""The user-item matrix as a long table: one row per stored cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.functions.columns import confidence
from shelfmate.operators.identity import dense_codes
from shelfmate.schemas import ITEM, USER


def rating_matrix(df: DataFrame, user: str = USER, item: str = ITEM, rating: str = "rating") -> DataFrame:
    """Sum of ratings per cell. Repeated reviews collapse before the shuffle."""
    cells = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    return cells.groupBy(user, item).agg(F.sum(F.col(rating).cast("double")).alias("w"))


def confidence_matrix(
    df: DataFrame, alpha: float = 40.0, user: str = USER, item: str = ITEM, rating: str = "rating"
) -> DataFrame:
    """Sum of ``1 + alpha * rating`` per cell."""
    cells = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    return cells.groupBy(user, item).agg(F.sum(confidence(F.col(rating).cast("double"), alpha)).alias("c"))


def item_norms(cells: DataFrame, item: str = ITEM, weight: str = "w") -> DataFrame:
    """(item, norm, n_cells): length and number of stored cells of every item row."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)))
    return cells.groupBy(item).agg(norm.alias("norm"), F.count(F.lit(1)).alias("n_cells"))


def coded_items(cells: DataFrame) -> DataFrame:
    """(item, norm, n_cells, item_idx): everything the neighbour search needs to know of an item."""
    return dense_codes(item_norms(cells), ITEM, "item_idx")
