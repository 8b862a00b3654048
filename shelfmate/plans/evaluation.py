"""End-to-end evaluation reports of both recommenders."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.operators.holdout import leave_one_out, sample_users, time_holdout
from shelfmate.operators.metrics import drop_unknown_items, rank_metrics, target_ranks
from shelfmate.plans.als_recommender import AlsParams, AlsRecommender, observed_ratings
from shelfmate.plans.knn_recommender import KnnRecommender
from shelfmate.schemas import ITEM, USER
from shelfmate.session import cut_lineage, stored


def evaluate_knn(
    model: KnnRecommender,
    ks: list[int],
    n_users: int = 1000,
    min_history: int = 5,
    max_history: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Random leave-one-out on a stored model, which has seen the targets.

    The split is small (users x history) and used three times, so it is kept.
    """
    split = cut_lineage(leave_one_out(model.cells, n_users, min_history, max_history, seed))
    histories = split.where(F.col("pos") > 0).select(F.col(USER).alias("query"), "pos", ITEM)
    targets = split.where(F.col("pos") == 0).select(F.col(USER).alias("query"), ITEM)
    found = model.recommend_histories(histories, max(ks)).where(F.col("status") == "ok").drop("status")
    answers = drop_unknown_items(found, model.catalogue, "query", ITEM)
    return rank_metrics(target_ranks(answers, targets, ["query", ITEM]), ks)


def evaluate_als(
    interactions: DataFrame,
    row_id: list[str],
    path: str,
    ks: list[int],
    params: AlsParams = AlsParams(),
    n_users: int = 1000,
    min_history: int = 5,
) -> DataFrame:
    """Time-based holdout: train without every user's latest interaction, then look for it.

    One row: parameters, matrix size, seconds, metrics and the share of targets the user had
    already met in training, which can never be found because known items are left out.
    """
    rows = observed_ratings(interactions, params, also_required=["timestamp"])
    # Used by the split, the training and the counts: made once, with the columns these need.
    wanted = dict.fromkeys([USER, ITEM, "rating", "timestamp", *row_id, "product_title"])
    rows = stored(rows.select(*[c for c in wanted if c in rows.columns]), "reviews")
    split = time_holdout(rows, row_id, min_history)
    started = time.perf_counter()
    model = AlsRecommender.fit(split.train, path, params)
    trained = time.perf_counter()

    # One row per user, so the sample is taken from the holdout itself.
    sampled = sample_users(split.holdout.select(USER, ITEM), n_users, params.seed)
    targets = cut_lineage(
        sampled.join(model.tables["users"], USER, "left")
        .join(model.tables["catalogue"].select(ITEM, "item_idx"), ITEM, "left")
        .select(F.col("user_idx").alias("query"), "item_idx")
    )
    answers = model.recommend_users(targets.select(F.col("query").alias("user_idx")), max(ks))
    metrics = rank_metrics(target_ranks(answers, targets, ["query", "item_idx"]), ks)
    row = metrics.first().asDict()
    finished = time.perf_counter()

    known = model.tables["cells"].select(F.col("user_idx").alias("query"), "item_idx")
    report = {
        "factors": params.factors,
        "iterations": params.iterations,
        "regularization": params.regularization,
        "alpha": params.alpha,
        "min_rating": params.min_rating,
        "n_users": rows.select(USER).distinct().count(),
        "n_items": rows.select(ITEM).distinct().count(),
        "nnz_train": model.tables["cells"].count(),
        "n_already_seen": targets.join(known, ["query", "item_idx"], "left_semi").count(),
        "train_s": trained - started,
        "eval_s": finished - trained,
        **row,
    }
    return interactions.sparkSession.createDataFrame([report])
