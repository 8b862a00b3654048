"""Holdout protocols: latest interaction per user, and random leave-one-out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.functions.columns import hash_order
from shelfmate.operators.joins import splittable_join
from shelfmate.schemas import ITEM, USER


class TimeSplit(NamedTuple):
    train: DataFrame
    holdout: DataFrame


def last_interactions(df: DataFrame, row_id: list[str], user: str = USER, time: str = "timestamp") -> DataFrame:
    """The latest row of every user with the user's row count ``n_rows``.

    Among equally late rows the smallest row id is taken. First the latest moment and the row count, which
    fit a hash aggregate: a user with a third of all rows is one row per task. Only the rows of that moment
    go on to the tie-break.
    """
    others = [c for c in df.columns if c not in {user, time, *row_id}]
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        moment = F.unix_micros(time)
    elif isinstance(kind, T.TimestampNTZType):
        moment = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    else:
        moment = F.col(time)
    rows = df.where(F.col(user).isNotNull() & F.col(time).isNotNull()).withColumn("_moment", moment)
    latest = rows.groupBy(user).agg(F.max("_moment").alias("_moment"), F.count(F.lit(1)).alias("n_rows"))
    tied = splittable_join(rows, latest, [user, "_moment"], "inner")
    last = tied.groupBy(user, "n_rows").agg(F.min(F.struct(*row_id, time, *others)).alias("last"))
    return last.select(user, "n_rows", *[F.col(f"last.{c}").alias(c) for c in [time, *row_id, *others]])


def time_holdout(
    df: DataFrame, row_id: list[str], min_history: int = 5, user: str = USER, time: str = "timestamp"
) -> TimeSplit:
    """Train on all rows but each user's latest; evaluate users with enough rows.

    The latest row of an ineligible user leaves training too. Rows are removed by their id,
    not by value, so repeated interactions survive; the id is unique, so that join has no
    hot key.
    """
    narrow = df.select(*dict.fromkeys([user, time, *row_id, *[c for c in df.columns if c in (ITEM, "rating", "item_idx")]]))
    last = last_interactions(narrow, row_id, user, time)
    train = df.join(last.select(*row_id), row_id, "left_anti").select(df.columns)
    holdout = last.where(F.col("n_rows") >= min_history)
    return TimeSplit(train, holdout)


def eligible_users(df: DataFrame, min_history: int = 5, distinct: bool = False, user: str = USER, item: str = ITEM) -> DataFrame:
    """Users with at least ``min_history`` rows, or distinct items."""
    rows = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    if distinct:
        # Cells first: repeated pairs collapse before the shuffle.
        rows = rows.groupBy(user, item).agg(F.lit(1).alias("one"))
    counts = rows.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_history)


def sample_users(users: DataFrame, n: int, seed: int = 42, user: str = USER) -> DataFrame:
    """``n`` users in hash order: a per-task top-n and a merge, the same on any cluster."""
    return users.orderBy(hash_order(seed, F.col(user)), user).limit(n)


def leave_one_out(
    cells: DataFrame,
    n_users: int = 1000,
    min_history: int = 5,
    max_history: int = 0,
    seed: int = 42,
    user: str = USER,
    item: str = ITEM,
) -> DataFrame:
    """(user, item, pos): position 0 is the held-out target, 1.. the history.

    ``cells`` has one row per (user, item). Users with at least ``min_history`` items are
    sampled; the target is the first item in hash order. Whole histories are kept; ``max_history`` above 0
    keeps that many items of each, in the same order.
    """
    order = hash_order(seed, F.col(user), F.col(item))
    users = sample_users(eligible_users(cells, min_history, False, user, item).select(user), n_users, seed, user)
    rows = cells.select(user, item).join(users, user, "left_semi").withColumn("h", order)
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(user).orderBy("h", item)))
    if max_history:
        # Written on the row number itself, so that each task keeps only these rows per user.
        ranked = ranked.where(F.col("place") <= max_history + 1)
    return ranked.select(user, item, (F.col("place") - 1).alias("pos"))
