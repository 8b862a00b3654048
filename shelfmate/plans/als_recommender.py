"""Implicit-feedback ALS: training, the stored model and its batch queries."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmate.operators.als import fit_plain, residuals
from shelfmate.operators.cleaning import coerce_rating, min_rating
from shelfmate.operators.factors import fold_in, gram_array, ridge_factor, similar_items, top_items
from shelfmate.operators.identity import build_catalogue, dense_codes, encode, title_or_default
from shelfmate.operators.matrix import confidence_matrix
from shelfmate.operators.search import search_titles
from shelfmate.plans.knn_recommender import answer_histories, answer_seeds, check_top_k
from shelfmate.schemas import ITEM, USER
from shelfmate.session import cut_lineage, ensure_checkpoint_dir
from shelfmate.sources.tables import write_report

# Spark reads a zero preference as "not observed".
SMALLEST_PREFERENCE = 1e-6
# Spark's ALS sends a vector to every block with one of its cells, in every half-step: few blocks, whatever the number of cores.
LEAST_BLOCKS, CELLS_PER_BLOCK = 5, 3_000_000
# Beyond so many cells its copies of the vectors cost more than all else: half-steps over written vectors solve the same equations.
MOST_SHUFFLED_CELLS = 1_000_000


@dataclass(frozen=True)
class AlsParams:
    factors: int = 64
    iterations: int = 20
    regularization: float = 0.05
    alpha: float = 40.0
    min_rating: float = 4.0
    seed: int = 42
    #: The ridge term as it is, by half-steps over DataFrames; otherwise Spark's ALS, which scales it by the number of cells.
    plain_ridge: bool = False


def observed_ratings(interactions: DataFrame, params: AlsParams, also_required: list[str] | None = None) -> DataFrame:
    return min_rating(coerce_rating(interactions, also_required=also_required), params.min_rating)


def fit_factors(cells: DataFrame, params: AlsParams) -> tuple[DataFrame, DataFrame]:
    """(user_idx, vector) and (item_idx, vector) from cells (user_idx, item_idx, c).

    Spark weighs a cell ``1 + alpha * r``; feeding ``r = c - 1`` with alpha 1 gives the same
    weight c. Its ridge term is scaled by the number of cells of the user or item.
    Block counts follow the number of cells alone, so neither what is shuffled nor the random start depends on the cluster;
    cores beyond the blocks idle in these steps, and the cells of one hot user or item stay in one block. More than MOST_SHUFFLED_CELLS
    cells, and ``plain_ridge``, go to fit_plain, which solves the same equations (the ridge scaled or not), shuffles no vector,
    uses all cores and splits hot rows.
    """
    if params.alpha <= 0:
        raise ValueError("alpha must be positive")
    if params.plain_ridge:
        return fit_plain(cells, params.factors, params.iterations, params.regularization, params.seed)
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    n_cells = cells.count()
    if n_cells > MOST_SHUFFLED_CELLS:
        weighed = cells.select("user_idx", "item_idx", (1 + F.greatest(F.col("c") - 1, F.lit(SMALLEST_PREFERENCE))).alias("c"))
        return fit_plain(weighed, params.factors, params.iterations, params.regularization, params.seed, scaled=True, kind="float")
    blocks = max(LEAST_BLOCKS, -(-n_cells // CELLS_PER_BLOCK))
    als = ALS(
        rank=params.factors,
        maxIter=params.iterations,
        regParam=params.regularization,
        alpha=1.0,
        implicitPrefs=True,
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="preference",
        seed=params.seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=5,
    )
    preference = F.greatest(F.col("c") - 1, F.lit(SMALLEST_PREFERENCE)).cast("float").alias("preference")
    model = als.fit(cells.select("user_idx", "item_idx", preference))
    users = model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("vector"))
    items = model.itemFactors.select(F.col("id").alias("item_idx"), F.col("features").alias("vector"))
    return users, items


def equation_residuals(cells: DataFrame, users: DataFrame, items: DataFrame, regularization: float, plain: bool = False) -> DataFrame:
    """(user_idx, n_cells, residual): how far each user vector is from solving its equation.

    ``(Y'Y + sum (c-1) y y' + reg n I) x = sum c y`` (without n if ``plain``), largest absolute component, relative to
    the largest component of the right side.
    """
    return residuals(cells, users, items, regularization, scaled=not plain)


class AlsRecommender:
    """Factors, cells, user codes, catalogue and the factorised Gram matrix (one row per line of it) as Parquet tables,
    parameters and training report as JSON."""

    TABLES = ("user_factors", "item_factors", "cells", "users", "catalogue", "ridge_factor")

    def __init__(self, tables: dict[str, DataFrame], params: AlsParams):
        self.tables = tables
        self.params = params
        self._factor = None

    @property
    def factor(self) -> np.ndarray:
        """The stored factor of Y'Y + reg I: f x f numbers, read once."""
        if self._factor is None:
            self._factor = np.array([r.line for r in self.tables["ridge_factor"].orderBy("i").collect()])
        return self._factor

    @classmethod
    def fit(cls, interactions: DataFrame, path: str, params: AlsParams = AlsParams()) -> "AlsRecommender":
        """Encode, weigh, train and store. The cells are written before training, so the
        iterations read a small table instead of repeating the joins."""
        spark, started = interactions.sparkSession, time.monotonic()
        rows = observed_ratings(interactions, params)
        # What the rows are derived from (filters, a holdout) is evaluated once.
        wanted = [c for c in (USER, ITEM, "rating", "product_title") if c in rows.columns]
        rows.select(*wanted).write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        if "product_title" not in rows.columns:
            rows = rows.withColumn("product_title", F.lit(None).cast("string"))
        build_catalogue(rows).write.mode("overwrite").parquet(f"{path}/catalogue")
        keys = rows.where(F.col(USER).isNotNull()).select(USER).distinct()
        dense_codes(keys, USER, "user_idx").write.mode("overwrite").parquet(f"{path}/users")
        users = spark.read.parquet(f"{path}/users")
        catalogue = spark.read.parquet(f"{path}/catalogue")
        weighted = confidence_matrix(rows, params.alpha)
        coded = encode(encode(weighted, users, USER), catalogue.select(ITEM, "item_idx"), ITEM)
        coded.select("user_idx", "item_idx", "c").write.mode("overwrite").parquet(f"{path}/cells")
        cells, prepared = spark.read.parquet(f"{path}/cells"), time.monotonic()
        user_factors, item_factors = fit_factors(cells, params)
        user_factors.write.mode("overwrite").parquet(f"{path}/user_factors")
        item_factors.write.mode("overwrite").parquet(f"{path}/item_factors")
        trained = time.monotonic()
        factor = ridge_factor(gram_array(spark.read.parquet(f"{path}/item_factors")), params.regularization)
        lines = spark.createDataFrame([(i, line.tolist()) for i, line in enumerate(factor)], "i int, line array<double>")
        lines.coalesce(1).write.mode("overwrite").parquet(f"{path}/ridge_factor")
        counts = {"n_rows": rows, "n_users": users, "n_items": catalogue, "n_cells": cells}
        seconds = {"prepare_s": prepared - started, "train_s": trained - prepared, "total_s": time.monotonic() - started}
        write_report(spark, {**{k: v.count() for k, v in counts.items()}, **seconds}, f"{path}/report")
        spark.createDataFrame([asdict(params)]).coalesce(1).write.mode("overwrite").json(f"{path}/params")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AlsRecommender":
        stored = spark.read.json(f"{path}/params").first().asDict()
        params = AlsParams(**{k: v for k, v in stored.items() if k in AlsParams.__dataclass_fields__})
        return cls({name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}, params)

    def _described(self, ranked: DataFrame) -> DataFrame:
        return ranked.join(self.tables["catalogue"], "item_idx", "left").select(
            "query",
            "rank",
            F.coalesce(ITEM, F.lit("")).alias(ITEM),
            "item_idx",
            title_or_default().alias("title"),
            "score",
        )

    def recommend_users(self, users: DataFrame, top_k: int = 10, exclude_seen: bool = True) -> DataFrame:
        """Top items for users (user_idx) of the training matrix, their own items left out."""
        check_top_k(top_k)
        asked = users.select("user_idx").distinct()
        queries = self.tables["user_factors"].join(asked, "user_idx", "left_semi")
        queries = queries.withColumnRenamed("user_idx", "query")
        seen = None
        if exclude_seen:
            seen = self.tables["cells"].join(asked, "user_idx", "left_semi")
            seen = seen.select(F.col("user_idx").alias("query"), "item_idx")
        return self._described(top_items(queries, self.tables["item_factors"], top_k, exclude=seen))

    def recommend_histories(self, histories: DataFrame, top_k: int = 10) -> DataFrame:
        """Top items for histories (query, item_idx) of people outside the training matrix."""
        check_top_k(top_k)
        items = self.tables["item_factors"]
        # Scoring counts the queries before it uses them, so they are solved once and kept.
        queries = cut_lineage(fold_in(histories, items, self.params.regularization, factor=self.factor))
        return self._described(top_items(queries, items, top_k, exclude=histories.select("query", "item_idx")))

    def recommend_item_histories(self, histories: DataFrame, top_k: int = 10) -> DataFrame:
        """Top items for histories (query, asin) given by item key, with a row for each history that is unknown."""
        catalogue = self.tables["catalogue"]
        known = histories.join(catalogue.select(ITEM, "item_idx"), ITEM).join(
            self.tables["item_factors"].select("item_idx"), "item_idx", "left_semi"
        )
        known = cut_lineage(known.select("query", "item_idx"))
        ranked = self.recommend_histories(known, top_k).select("query", "rank", "item_idx", "score")
        return answer_histories(ranked, known, histories, catalogue)

    def similar(self, seeds: DataFrame, top_k: int = 10) -> DataFrame:
        """Items close to each seed (column ``seed``, an item key) in factor space."""
        check_top_k(top_k)
        catalogue = self.tables["catalogue"]
        wanted = catalogue.join(seeds.select(F.col("seed").alias(ITEM)).distinct(), ITEM, "left_semi")
        near = similar_items(self.tables["item_factors"], top_k, wanted.select("item_idx"))
        near = near.select(F.col("query").alias("item_idx"), "rank", F.col("item_idx").alias("other_idx"), "score")
        return answer_seeds(near, catalogue, seeds)

    def search(self, queries: list[str] | DataFrame, limit: int = 10) -> DataFrame:
        return search_titles(self.tables["catalogue"], queries, limit)
