"""Item-neighbour recommendations as batch operators, and the stored model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmate.operators.cleaning import coerce_rating
from shelfmate.operators.identity import item_titles, title_or_default
from shelfmate.operators.joins import splittable_join
from shelfmate.operators.knn import cosine_neighbours, cosine_similarities, history_scores
from shelfmate.operators.matrix import coded_items, rating_matrix
from shelfmate.operators.search import search_titles
from shelfmate.schemas import ITEM, USER

MAX_TOP_K = 100
# Folders of a stored graph: about so many items in each, and never more folders than a driver can list.
ITEMS_PER_BUCKET, MAX_BUCKETS = 20_000, 2_000
INFO = "graph_depth int, buckets int"
GRAPH = "asin string, rank int, other string, score double, bucket int"


def check_top_k(top_k: int) -> None:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")


def answer_seeds(neighbours: DataFrame, catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, seed_title, rank, asin, title, score, status) from (item_idx, rank, other_idx, score).

    Every seed asked for has at least one row: one the catalogue does not know has status ``not_found``, a
    known one without neighbours ``no_neighbours``.
    """
    known = catalogue.select(F.col(ITEM).alias("seed"), "item_idx", title_or_default().alias("seed_title"))
    asked = seeds.select("seed").distinct().join(known, "seed", "left")
    target = catalogue.select(F.col("item_idx").alias("other_idx"), ITEM, title_or_default().alias("title"))
    listed = splittable_join(neighbours, target, ["other_idx"], "left")
    status = (
        F.when(F.col("item_idx").isNull(), F.lit("not_found")).when(F.col("rank").isNull(), F.lit("no_neighbours")).otherwise(F.lit("ok"))
    )
    return asked.join(listed, "item_idx", "left").select(
        "seed",
        "seed_title",
        "rank",
        F.when(F.col("rank").isNotNull(), F.coalesce(ITEM, F.lit(""))).alias(ITEM),
        F.when(F.col("rank").isNotNull(), title_or_default()).alias("title"),
        "score",
        status.alias("status"),
    )


def recommend_seeds(cells: DataFrame, catalogue: DataFrame, seeds: DataFrame, top_k: int = 10, **options) -> DataFrame:
    """Neighbours of every seed item, the seed itself left out."""
    check_top_k(top_k)
    wanted = (
        catalogue.join(seeds.select(F.col("seed").alias(ITEM)).distinct(), ITEM, "left_semi")
        .select("item_idx", F.lit(top_k).alias("k"))
    )
    neighbours = cosine_neighbours(cells, catalogue, top_k, seeds=wanted, **options)
    return answer_seeds(neighbours, catalogue, seeds)


def recommend_histories(
    cells: DataFrame, catalogue: DataFrame, histories: DataFrame, top_k: int = 10, **options
) -> DataFrame:
    """(query, rank, asin, item_idx, title, score, status) for histories (query, pos, asin).

    Every history has at least one row: without a known item its status is ``not_found``, without an answer
    ``no_neighbours``. Neighbour lists are taken in history order, each top_k + history length long, so the
    list of the first known item always fills the answer: the result is that item's
    neighbours without the history. Each first item is searched once, as deep as the
    longest history that starts with it needs.
    """
    check_top_k(top_k)
    known = histories.join(catalogue.select(ITEM, "item_idx"), ITEM).select("query", "pos", "item_idx")
    first = known.groupBy("query").agg(
        F.min_by("item_idx", F.struct("pos", "item_idx")).alias("item_idx"),
        (F.count(F.lit(1)) + top_k).cast("int").alias("depth"),
    )
    seeds = first.groupBy("item_idx").agg(F.max("depth").alias("k"))
    neighbours = cosine_neighbours(cells, catalogue, top_k, seeds=seeds, **options)
    deep_enough = neighbours.withColumnRenamed("rank", "place").join(first, "item_idx").where(F.col("place") <= F.col("depth"))
    unseen = deep_enough.select("query", "place", "score", F.col("other_idx").alias("item_idx")).join(
        known.select("query", "item_idx"), ["query", "item_idx"], "left_anti"
    )
    ranked = unseen.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("place")))
    return answer_histories(ranked.where(F.col("rank") <= top_k), first, histories, catalogue)


def answer_histories(ranked: DataFrame, known: DataFrame, histories: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Ranked answers (query, rank, item_idx, score) with titles, and a row for each history without any."""
    listed = ranked.select("query", "rank", "item_idx", "score").join(
        catalogue.select("item_idx", ITEM, title_or_default().alias("title")), "item_idx", "left"
    )
    asked = histories.select("query").distinct().join(
        known.select("query").distinct().withColumn("_known", F.lit(True)), "query", "left"
    )
    status = F.when(F.col("_known").isNull(), F.lit("not_found")).when(F.col("rank").isNull(), F.lit("no_neighbours"))
    return asked.join(listed, "query", "left").select(
        "query",
        "rank",
        F.when(F.col("rank").isNotNull(), F.coalesce(ITEM, F.lit(""))).alias(ITEM),
        "item_idx",
        F.when(F.col("rank").isNotNull(), title_or_default()).alias("title"),
        "score",
        status.otherwise(F.lit("ok")).alias("status"),
    )


def recommend_histories_by_score(
    cells: DataFrame, catalogue: DataFrame, histories: DataFrame, top_k: int = 10, how: str = "sum", nearest: int | None = None, **options
) -> DataFrame:
    """Like recommend_histories, but each candidate is scored by the sum or maximum of its positive similarities to
    all items of the history; ties by item code. Only the final ranking is cut to ``top_k``.

    Equal pairs of history and item count once. With ``nearest`` only similarities among an item's so many nearest
    count, history items among them: sums then miss the others, and a closely knit history has few answers or none.
    """
    check_top_k(top_k)
    if how not in ("sum", "max"):
        raise ValueError("how must be sum or max")
    known = histories.join(catalogue.select(ITEM, "item_idx"), ITEM).select("query", "item_idx").distinct()
    if nearest is None:
        ranked = history_scores(cells, catalogue, known, top_k, how, **options)
        if ranked is not None:
            return answer_histories(ranked, known, histories, catalogue)
    seeds = known.select("item_idx").distinct()
    if nearest is None:
        near = cosine_similarities(cells, catalogue, seeds, **options)
    else:
        near = cosine_neighbours(cells, catalogue, nearest, seeds=seeds.withColumn("k", F.lit(nearest)), **options)
    met = splittable_join(known, near, ["item_idx"], "inner").select("query", F.col("other_idx").alias("item_idx"), "score")
    # Sums of whole steps, so that they do not depend on the order of addition.
    total = F.sum(F.round(F.col("score") * 1e9).cast("long")) if how == "sum" else F.max(F.round(F.col("score") * 1e9).cast("long"))
    scored = met.groupBy("query", "item_idx").agg((total / F.lit(1e9)).alias("score"))
    unseen = splittable_join(scored, known, ["query", "item_idx"], "left_anti")
    order = W.partitionBy("query").orderBy(F.desc("score"), "item_idx")
    ranked = unseen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return answer_histories(ranked, known, histories, catalogue)


def best_of_category(cells: DataFrame, catalogue: DataFrame, targets: DataFrame, categories: DataFrame, depth: int) -> DataFrame:
    """(item_idx, other_idx, score): at least the ``depth`` highest similarities of every item inside the category of its target.

    ``targets`` (item_idx, asin), ``categories`` (asin, category). An item or target of several categories leaves the choice to the caller:
    all similarities are returned then.
    """
    kinds = categories.where(F.col(ITEM).isNotNull()).select(ITEM, "category").distinct()
    one_each = kinds.groupBy(ITEM).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    one_target = targets.distinct().groupBy("item_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    every = catalogue.select("item_idx")
    if not (one_each and one_target):
        return cosine_similarities(cells, catalogue, every)
    named = kinds.where(F.col("category").isNotNull()).select(ITEM, F.xxhash64("category").alias("label"))
    labels = catalogue.select("item_idx", ITEM).join(named, ITEM, "left").select("item_idx", "label")
    wanted = targets.distinct().join(named.withColumnRenamed("label", "want"), ITEM).select("item_idx", "want")
    return cosine_similarities(cells, catalogue, every, labels=labels.join(wanted, "item_idx", "left"), depth=depth)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def model_catalogue(cells: DataFrame, interactions: DataFrame) -> DataFrame:
    """(asin, norm, n_cells, item_idx, title)"""
    return coded_items(cells).join(item_titles(interactions), ITEM, "left")


def answer_from_lists(lists: DataFrame, catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """Like answer_seeds, from lists (asin, rank, other, score) of item keys."""
    titled = catalogue.select(ITEM, title_or_default().alias("title"))
    asked = seeds.select("seed").distinct().join(titled.select(F.col(ITEM).alias("seed"), F.col("title").alias("seed_title")), "seed", "left")
    listed = splittable_join(lists.withColumnRenamed(ITEM, "seed").withColumnRenamed("other", ITEM), titled, [ITEM], "left")
    status = F.when(F.col("seed_title").isNull(), F.lit("not_found")).when(F.col("rank").isNull(), F.lit("no_neighbours"))
    return asked.join(listed, "seed", "left").select(
        "seed", "seed_title", "rank", ITEM, "title", "score", status.otherwise(F.lit("ok")).alias("status")
    )


def with_keys(neighbours: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(item_idx, rank, other_idx, score) as (asin, rank, other, score)."""
    names = catalogue.select("item_idx", ITEM)
    other = names.select(F.col("item_idx").alias("other_idx"), F.col(ITEM).alias("other"))
    keyed = splittable_join(splittable_join(neighbours, names, ["item_idx"], "inner"), other, ["other_idx"], "inner")
    return keyed.select(ITEM, "rank", "other", "score")


def items_to_refresh(cells: DataFrame, changed: DataFrame) -> DataFrame:
    """(asin): items whose lists may differ after the cells of the ``changed`` items (asin) did.

    A changed item has another length, so all its similarities change: those of every item that shares a user with it.
    """
    users = splittable_join(cells, changed, [ITEM], "left_semi").select(USER).distinct()
    return splittable_join(cells, users, [USER], "left_semi").select(ITEM).distinct()


class KnnRecommender:
    """The stored model: matrix cells, catalogue and, if asked for, the neighbour graph as Parquet tables.

    The graph holds the ``graph_depth`` best neighbours of every item by key, in folders by a hash of the item and
    sorted inside, so answering a seed reads the seed's folder instead of multiplying the matrix.
    """

    def __init__(self, cells: DataFrame, catalogue: DataFrame, graph: DataFrame | None = None, graph_depth: int = 0, buckets: int = 1):
        self.cells = cells
        self.catalogue = catalogue
        self.graph = graph
        self.graph_depth = graph_depth
        self.buckets = buckets

    @classmethod
    def fit(cls, interactions: DataFrame, path: str, graph_depth: int = 0) -> "KnnRecommender":
        """Write the tables once; every later query scans them instead of the reviews. No graph is stored at depth 0."""
        spark = interactions.sparkSession
        rating_matrix(coerce_rating(interactions)).write.mode("overwrite").parquet(f"{path}/cells")
        cells = spark.read.parquet(f"{path}/cells")
        model_catalogue(cells, interactions).write.mode("overwrite").parquet(f"{path}/catalogue")
        catalogue = spark.read.parquet(f"{path}/catalogue")
        lists = with_keys(cosine_neighbours(cells, catalogue, graph_depth), catalogue) if graph_depth else None
        return cls._store_graph(spark, path, catalogue, lists, graph_depth)

    @classmethod
    def _store_graph(cls, spark: SparkSession, path: str, catalogue: DataFrame, lists: DataFrame | None, depth: int) -> "KnnRecommender":
        buckets = max(1, min(MAX_BUCKETS, catalogue.count() // ITEMS_PER_BUCKET))
        if lists is not None:
            placed = lists.withColumn("bucket", _bucket(F.col(ITEM), buckets)).repartition("bucket").sortWithinPartitions("bucket", ITEM, "rank")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/graph")
        info = spark.createDataFrame([(depth, buckets)], INFO)
        info.coalesce(1).write.mode("overwrite").json(f"{path}/info")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KnnRecommender":
        info = spark.read.schema(INFO).json(f"{path}/info").first()
        graph = spark.read.schema(GRAPH).parquet(f"{path}/graph") if info.graph_depth else None
        return cls(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/catalogue"), graph, info.graph_depth, info.buckets)

    def refresh(self, interactions: DataFrame, path: str) -> "KnnRecommender":
        """The model with further interactions, stored at ``path`` (another one than this model's).

        Only the lists of ``items_to_refresh`` are computed; all others are copied.
        """
        spark = interactions.sparkSession
        added = rating_matrix(coerce_rating(interactions))
        added.write.mode("overwrite").parquet(f"{path}/added")
        added = spark.read.parquet(f"{path}/added")
        both = self.cells.select(USER, ITEM, "w").unionByName(added.select(USER, ITEM, "w"))
        both.groupBy(USER, ITEM).agg(F.sum("w").alias("w")).write.mode("overwrite").parquet(f"{path}/cells")
        cells = spark.read.parquet(f"{path}/cells")
        titles = self.catalogue.select(ITEM, F.col("title").alias("product_title")).unionByName(interactions.select(ITEM, "product_title"))
        model_catalogue(cells, titles).write.mode("overwrite").parquet(f"{path}/catalogue")
        catalogue = spark.read.parquet(f"{path}/catalogue")
        lists = None
        if self.graph_depth:
            items_to_refresh(cells, added.select(ITEM).distinct()).write.mode("overwrite").parquet(f"{path}/refreshed")
            stale = spark.read.parquet(f"{path}/refreshed")
            seeds = splittable_join(catalogue, stale, [ITEM], "left_semi").select("item_idx", F.lit(self.graph_depth).alias("k"))
            fresh = with_keys(cosine_neighbours(cells, catalogue, self.graph_depth, seeds=seeds), catalogue)
            kept = splittable_join(self.graph.drop("bucket"), stale, [ITEM], "left_anti")
            lists = kept.select(*fresh.columns).unionByName(fresh)
        return self._store_graph(spark, path, catalogue, lists, self.graph_depth)

    def lists(self, seeds: DataFrame, top_k: int) -> DataFrame:
        """(asin, rank, other, score) of the stored graph for items (seed). Only the folders of the seeds are read."""
        asked = seeds.select(F.col("seed").alias(ITEM), _bucket(F.col("seed"), self.buckets).alias("bucket")).distinct()
        folders = [r.bucket for r in asked.where(F.col("bucket").isNotNull()).select("bucket").distinct().collect()]  # at most MAX_BUCKETS
        near = self.graph.where(F.col("bucket").isin(folders) & (F.col("rank") <= top_k))
        return splittable_join(near, asked, [ITEM, "bucket"], "left_semi").drop("bucket")

    def neighbours(self, top_k: int = 10) -> DataFrame:
        return cosine_neighbours(self.cells, self.catalogue, top_k)

    def recommend(self, seeds: DataFrame, top_k: int = 10) -> DataFrame:
        """From the graph where it is deep enough, else from the matrix; the answers are the same."""
        check_top_k(top_k)
        if top_k <= self.graph_depth:
            return answer_from_lists(self.lists(seeds, top_k), self.catalogue, seeds)
        return recommend_seeds(self.cells, self.catalogue, seeds, top_k)

    def recommend_histories(self, histories: DataFrame, top_k: int = 10) -> DataFrame:
        return recommend_histories(self.cells, self.catalogue, histories, top_k)

    def recommend_histories_by_score(
        self, histories: DataFrame, top_k: int = 10, how: str = "sum", nearest: int | None = None
    ) -> DataFrame:
        return recommend_histories_by_score(self.cells, self.catalogue, histories, top_k, how, nearest)

    def search(self, queries: list[str] | DataFrame, limit: int = 10) -> DataFrame:
        return search_titles(self.catalogue, queries, limit)

    def health(self) -> DataFrame:
        """(n_users, n_items, n_cells) of the loaded model."""
        users = self.cells.select(USER).distinct().agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_users").alias("metric"), "v")
        items = self.catalogue.agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_items").alias("metric"), "v")
        cells = self.cells.agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_cells").alias("metric"), "v")
        return users.unionByName(items).unionByName(cells)

