"""Row cleaning, the metadata join and the one-pass activity filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.functions.columns import strict_number
from shelfmate.operators.joins import splittable_join
from shelfmate.schemas import ITEM, JOIN_KEY, USER

# Activity thresholds of the interaction table.
MIN_REVIEWS_PER_USER = 6
MIN_REVIEWS_PER_ITEM = 11


def coerce_rating(df: DataFrame, column: str = "rating", also_required: list[str] | None = None) -> DataFrame:
    """Rating as double; rows whose rating (or another required column) is missing are dropped."""
    if isinstance(df.schema[column].dataType, T.StringType):
        out = df.withColumn(column, strict_number(F.col(column)))
    else:
        # NaN is filtered, not rewritten, so that later comparisons still reach the file reader.
        out = df.withColumn(column, F.col(column).cast("double")).where(~F.isnan(column))
    for name in [column, *(also_required or [])]:
        out = out.where(F.col(name).isNotNull())
    return out


def min_rating(df: DataFrame, floor: float = 4.0, column: str = "rating") -> DataFrame:
    """Rows at or above the floor; a floor of zero keeps everything."""
    return df if floor <= 0 else df.where(F.col(column) >= floor)


def join_metadata(reviews: DataFrame, metadata: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left join on the product key. Spark broadcasts the metadata when its size allows;
    otherwise a product that owns most of the reviews is split over many tasks."""
    keys = on or [JOIN_KEY]
    left = reviews.withColumn(JOIN_KEY, F.col(JOIN_KEY).cast("string"))
    right = metadata.withColumn(JOIN_KEY, F.col(JOIN_KEY).cast("string"))
    return splittable_join(left, right, keys, "left")


def activity_counts(df: DataFrame, key: str, scope: list[str] | None = None) -> DataFrame:
    """Rows per key (within ``scope`` columns), counted before the shuffle."""
    keys = [*(scope or []), key]
    return df.where(F.col(key).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def core_filter(
    df: DataFrame,
    min_user: int = MIN_REVIEWS_PER_USER,
    min_item: int = MIN_REVIEWS_PER_ITEM,
    user: str = USER,
    item: str = ITEM,
    scope: list[str] | None = None,
) -> DataFrame:
    """Keep rows of active users on active items, in one pass.

    Both counts are taken on the unfiltered rows, so a surviving user may keep fewer rows
    than the threshold. Two semi joins against the passing keys: rows never get wider, a
    small key set is broadcast by size, a large one is shuffled and the rows of a hot user
    or item are split. ``scope`` counts within e.g. a category.
    """
    keys = scope or []
    users = activity_counts(df, user, scope).where(F.col("n") >= min_user).select(*keys, user)
    items = activity_counts(df, item, scope).where(F.col("n") >= min_item).select(*keys, item)
    by_active_users = splittable_join(df, users, [*keys, user], "left_semi")
    return splittable_join(by_active_users, items, [*keys, item], "left_semi").select(df.columns)
