"""

Test tables stand in for review data as follows: order lines are reviews (customer, part, a
1..5 rating from the quantity, order time), parts are product metadata, events are a second
interaction log, embeddings are item factors.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shelfmate.functions.columns import clean_text, confidence, dot, hybrid_score, recency_confidence  # noqa: E402
from shelfmate.operators import cleaning, factors, holdout, identity, matrix, metrics, profile, quantiles, sentiment  # noqa: E402
from shelfmate.operators.search import search_titles  # noqa: E402
from shelfmate.plans import als_recommender, categories, evaluation, knn_recommender  # noqa: E402
from shelfmate.plans.driver_tables import ROW_ID, event_cells, interactions, metadata, table  # noqa: E402
from shelfmate.session import cut_lineage, scratch_path, stored  # noqa: E402
from shelfmate.sources import json_lines, tables  # noqa: E402

try:  # the operators of a training-data pipeline are a subpackage that may be left out
    import corpus_pipeline
    from shelfmate.llm import registry as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("shelfmate.llm", "corpus_pipeline"):
        raise
    llm = None

KS = [5, 10, 20]
SEARCHES = ["RING", "red", "hot b", "50%", "_", "gizmo"]
ALS = als_recommender.AlsParams()


def six(column, name: str):
    return F.round(column, 6).alias(name)


# --- sources and sinks ---------------------------------------------------------------


def write_lines(df: DataFrame, order: list[str], lines, name: str) -> str:
    """JSON text files whose line order is the order of ``order``: range-partitioned, so
    file names sort like the keys."""
    path = scratch_path(df.sparkSession, name)
    df.orderBy(*order).select(F.explode(lines).alias("value")).write.text(path)
    return path


def q_load_reviews(spark, sf):
    rows = interactions(spark, sf)
    record = F.to_json(
        F.struct(
            F.col("reviewerID").alias("user_id"),
            F.col("reviewText").alias("text"),
            "asin",
            F.col("rating").cast("string").alias("rating"),
            "timestamp",
            F.lit("ignored").alias("verified"),
        )
    )
    path = scratch_path(spark, "reviews")
    rows.select(record.alias("value")).write.text(path)
    return cleaning.coerce_rating(json_lines.read_reviews(spark, path))


def part_review_lines(spark, sf):
    part = table(spark, sf, "part")
    record = F.to_json(
        F.struct(
            F.col("p_brand").alias("user_id"),
            F.col("p_name").alias("text"),
            F.col("p_partkey").cast("string").alias("asin"),
            F.col("p_size").cast("string").alias("rating"),
            F.col("p_partkey").alias("timestamp"),
        )
    )
    # Lines of promoted parts are cut short, so they are malformed but still count.
    line = F.when(F.col("p_type") == "PROMO", F.substring(record, 1, 20)).otherwise(record)
    return write_lines(part, ["p_partkey"], F.array(line), "part-reviews")


def q_load_reviews_limit(spark, sf):
    return json_lines.read_reviews(spark, part_review_lines(spark, sf), limit=100).drop("parent_asin")


def part_metadata_lines(spark, sf):
    """Two lines per part: the record and a later copy with another title. Promoted parts carry
    ``asin`` only; economy parts have a null title."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    promoted = F.col("p_type") == "PROMO"
    title = F.when(F.col("p_type") != "ECONOMY", F.col("p_name"))
    kind = F.col("p_type").alias("main_category")

    def record(title_column):
        named = F.struct(key.alias("parent_asin"), title_column.alias("title"), kind)
        unnamed = F.struct(key.alias("asin"), title_column.alias("title"), kind)
        return F.when(promoted, F.to_json(unnamed)).otherwise(F.to_json(named))

    junk = F.concat(record(title), F.lit(" trailing"))
    lines = F.array(record(title), record(F.lit("copy")), junk)
    return write_lines(part, ["p_partkey"], lines, "part-metadata")


def q_load_meta(spark, sf):
    return json_lines.read_metadata(spark, part_metadata_lines(spark, sf))


def q_load_meta_limit(spark, sf):
    return json_lines.read_metadata(spark, part_metadata_lines(spark, sf), limit=100)


def q_build_meta_cache(spark, sf):
    return json_lines.write_metadata_cache(spark, part_metadata_lines(spark, sf), scratch_path(spark, "meta-cache"))


def q_load_shards(spark, sf):
    """One shard per return flag; the shard of flag R stores ratings as text, one in seven of
    them not a number."""
    root = scratch_path(spark, "shards")
    rows = interactions(spark, sf).withColumn("flag", F.substring("reviewText", 1, 1))
    bad = F.when(F.col("l_linenumber") == 7, F.lit("bad")).otherwise(F.col("rating").cast("string"))
    paths = []
    for flag in ("A", "N", "R"):
        shard = rows.where(F.col("flag") == flag).select("reviewerID", "asin", "rating", *ROW_ID)
        if flag == "R":
            shard = shard.withColumn("rating", bad)
        shard.write.parquet(f"{root}/{flag}")
        paths.append(f"{root}/{flag}")
    shards = tables.read_shards(spark, paths, ["reviewerID", "asin", "rating"])
    return cleaning.coerce_rating(shards).groupBy("asin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total")
    )


def q_write_interactions(spark, sf):
    path = scratch_path(spark, "interactions")
    joined = cleaning.join_metadata(interactions(spark, sf), metadata(spark, sf))
    tables.write_interactions(joined, path)
    return spark.read.parquet(path)


def q_multi_category_build(spark, sf):
    meta = metadata(spark, sf).withColumn("category", F.col("main_category"))
    reviews = interactions(spark, sf).join(meta.select("parent_asin", "category"), "parent_asin")
    path = scratch_path(spark, "categories")
    built = categories.build_all_categories(reviews, meta)
    tables.write_interactions(built, path, partition_by="category")
    return spark.read.parquet(path).select("category", *tables.INTERACTION_COLUMNS)


def q_explode_categories(spark, sf):
    names = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    name = F.concat_ws(" ", "p_brand", "p_type")
    entry = F.struct(
        name.alias("name"),
        F.concat(name, F.lit(".jsonl")).alias("review_file"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit("meta_"), name, F.lit(".jsonl"))).alias("meta_file"),
    )
    path = scratch_path(spark, "config")
    names.agg(F.sort_array(F.collect_list(entry)).alias("categories")).coalesce(1).write.json(path)
    return tables.read_category_config(spark, path)


def q_run_report(spark, sf):
    events = event_cells(spark, sf)
    counts = events.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("reviewerID").alias("n_users")
    )
    stages = events.select("category", F.col("asin").alias("stage"), F.col("value").alias("seconds"))
    report = counts.join(categories.stage_totals(stages), "category")
    path = scratch_path(spark, "report")
    report.coalesce(1).write.json(path)
    return spark.read.schema(report.schema).json(path).withColumn("total_s", F.round("total_s", 2))


def q_category_report(spark, sf):
    """The category run itself, from files of JSON lines, one folder per product type, to the summary it writes."""
    root = scratch_path(spark, "category-run")
    meta = metadata(spark, sf).withColumn("category", F.col("main_category"))
    reviews = interactions(spark, sf).join(meta.select("parent_asin", "category"), "parent_asin")
    review = F.to_json(F.struct(F.col("reviewerID").alias("user_id"), "asin", "rating", "timestamp"))
    product = F.to_json(F.struct("parent_asin", F.col("product_title").alias("title"), "main_category"))
    reviews.select(review.alias("value"), "category").write.partitionBy("category").text(f"{root}/reviews")
    meta.select(product.alias("value"), "category").write.partitionBy("category").text(f"{root}/meta")
    files = [F.concat(F.lit(f"{kind}/category="), "category") for kind in ("reviews", "meta")]
    entry_ = F.struct(F.col("category").alias("name"), files[0].alias("review_file"), files[1].alias("meta_file"))
    kinds = meta.select("category").distinct()
    kinds.agg(F.sort_array(F.collect_list(entry_)).alias("categories")).coalesce(1).write.json(f"{root}/config")
    categories.run_categories(spark, f"{root}/config", root, f"{root}/out")
    return spark.read.json(f"{root}/out/timings_multi_summary.json").select("category", "status", "n_rows")


def q_recommender_roundtrip(spark, sf):
    path = scratch_path(spark, "knn-model")
    rows = interactions(spark, sf).withColumn("product_title", F.col("reviewText"))
    knn_recommender.KnnRecommender.fit(rows, path)
    return knn_recommender.KnnRecommender.load(spark, path).health()


# --- cleaning, joins, filters ----------------------------------------------------------


def q_coerce_rating(spark, sf):
    rating = (
        F.when(F.col("l_linenumber") == 1, "4.0")
        .when(F.col("l_linenumber") == 2, " 5 ")
        .when(F.col("l_linenumber") == 3, "abc")
        .when(F.col("l_linenumber") == 4, "5d")
        .when(F.col("l_linenumber") == 5, "NaN")
        .when(F.col("l_linenumber") == 6, "")
        .otherwise(F.col("rating").cast("string"))
    )
    return cleaning.coerce_rating(interactions(spark, sf).withColumn("rating", rating)).select(*ROW_ID, "rating")


def q_min_rating(spark, sf):
    return cleaning.min_rating(interactions(spark, sf)).select("reviewerID", "asin", "rating", "timestamp")


def q_confidence(spark, sf):
    return interactions(spark, sf).select(*ROW_ID, confidence(F.col("rating")).alias("c"))


def q_join_meta(spark, sf):
    return cleaning.join_metadata(interactions(spark, sf), metadata(spark, sf)).drop(*ROW_ID)


def with_missing_keys(rows):
    """Some rows without a user, some without an item."""
    nobody = (F.col("reviewText") == "R F") & (F.col("l_linenumber") == 7)
    nothing = (F.col("reviewText") == "A F") & (F.col("l_linenumber") == 6)
    return rows.withColumn("reviewerID", F.when(~nobody, F.col("reviewerID"))).withColumn("asin", F.when(~nothing, F.col("asin")))


def q_core_filter(spark, sf, **thresholds):
    # Rows that come from a join are made once, not for each count and for the filter again.
    rows = stored(with_missing_keys(interactions(spark, sf)).drop(*ROW_ID), "reviews")
    return categories.build_interactions(rows, metadata(spark, sf), **thresholds)


def q_core_filter_strict(spark, sf):
    return q_core_filter(spark, sf, min_user=30, min_item=28)


def q_dedup_meta(spark, sf):
    events = event_cells(spark, sf).select("asin", "category", "value", F.col("event_id").alias("position"))
    return json_lines.first_per_key(events, "asin", F.col("position"))


# --- counts, ids, matrix ---------------------------------------------------------------


def q_user_item_counts(spark, sf):
    rows = interactions(spark, sf)
    users = cleaning.activity_counts(rows, "reviewerID").select(F.lit("user").alias("kind"), F.col("reviewerID").alias("id"), "n")
    items = cleaning.activity_counts(rows, "asin").select(F.lit("item").alias("kind"), F.col("asin").alias("id"), "n")
    return users.unionByName(items)


def q_global_ids(spark, sf):
    shards = [
        interactions(spark, sf).select("asin"),
        event_cells(spark, sf).select("asin"),
        metadata(spark, sf).select(F.col("parent_asin").alias("asin")),
    ]
    return identity.distinct_keys(shards, "asin")


def q_encode_ids(spark, sf):
    rows = interactions(spark, sf)
    users = identity.dense_codes(identity.distinct_keys([rows], "reviewerID"), "reviewerID", "user_idx")
    items = identity.dense_codes(identity.distinct_keys([rows], "asin"), "asin", "item_idx")
    coded = identity.encode(identity.encode(rows, users, "reviewerID"), items, "asin")
    return coded.select(*ROW_ID, "user_idx", "item_idx", F.col("rating").cast("float").cast("double").alias("rating"))


def titled(spark, sf):
    return cleaning.join_metadata(interactions(spark, sf), metadata(spark, sf))


def q_catalogue(spark, sf):
    return identity.build_catalogue(titled(spark, sf))


def q_interaction_matrix(spark, sf):
    return matrix.rating_matrix(interactions(spark, sf))


def q_confidence_matrix(spark, sf):
    return matrix.confidence_matrix(cleaning.min_rating(interactions(spark, sf)))


def q_item_norms(spark, sf):
    norms = matrix.item_norms(matrix.rating_matrix(interactions(spark, sf)))
    return norms.select("asin", six(F.col("norm"), "norm"))


def q_dataset_profile(spark, sf):
    return profile.dataset_profile(interactions(spark, sf))


# --- neighbours, search, recommendations -----------------------------------------------


def stored_model(spark, sf):
    return knn_recommender.KnnRecommender.fit(titled(spark, sf), scratch_path(spark, "knn-model"))


def q_item_knn(spark, sf):
    near = stored_model(spark, sf).neighbours(10)
    return near.select("item_idx", "rank", "other_idx", six(F.col("score"), "score"))


def q_knn_refresh(spark, sf):
    """A stored graph of all but the last half year, brought up to date with that half year."""
    rows = titled(spark, sf)
    edge = rows.agg(F.max("timestamp").alias("_edge"))  # one row
    dated = rows.join(F.broadcast(edge)).withColumn("_recent", F.col("timestamp") > F.col("_edge") - 182 * 86400)
    old, new = (dated.where(F.col("_recent") == recent).drop("_edge", "_recent") for recent in (False, True))
    model = knn_recommender.KnnRecommender.fit(old, scratch_path(spark, "knn-model"), graph_depth=10)
    model = model.refresh(new, scratch_path(spark, "knn-model"))
    codes = model.catalogue.select("asin", "item_idx")
    others = codes.select(F.col("asin").alias("other"), F.col("item_idx").alias("other_idx"))
    return model.graph.join(codes, "asin").join(others, "other").select("item_idx", "rank", "other_idx", six(F.col("score"), "score"))


def supplier_keys(spark, sf, prefix):
    return table(spark, sf, "supplier").select(F.concat(F.lit(prefix), F.col("s_suppkey").cast("string")).alias("key"))


def q_recommend_seed(spark, sf):
    """Every part is asked for, and for each supplier an item that only one user has, so that it has no
    neighbours, and one that nobody has."""
    lonely = supplier_keys(spark, sf, "lonely-").select(
        F.col("key").alias("reviewerID"), F.col("key").alias("asin"), F.lit(5.0).alias("rating"), F.lit(None).cast("string").alias("product_title")
    )
    rows = titled(spark, sf).select("reviewerID", "asin", "rating", "product_title").unionByName(lonely)
    model = knn_recommender.KnnRecommender.fit(rows, scratch_path(spark, "knn-model"), graph_depth=10)
    seeds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"))
    for prefix in ("lonely-", "gone-"):
        seeds = seeds.unionByName(supplier_keys(spark, sf, prefix))
    return model.recommend(seeds.withColumnRenamed("key", "seed"), 10).withColumn("score", F.round("score", 6))


def customer_histories(spark, sf):
    """Every customer's whole order history, earliest first, and a history of unknown items per supplier."""
    order = F.struct("timestamp", *ROW_ID)
    rows = interactions(spark, sf)
    histories = rows.select(F.col("reviewerID").alias("query"), order.alias("pos"), "asin")
    no_order = F.lit(None).cast(histories.schema["pos"].dataType).alias("pos")
    gone = supplier_keys(spark, sf, "gone-").select(F.col("key").alias("query"), no_order, F.col("key").alias("asin"))
    return histories.unionByName(gone)


def q_recommend_history_first(spark, sf):
    found = stored_model(spark, sf).recommend_histories(customer_histories(spark, sf), 10)
    return found.withColumn("score", F.round("score", 6))


def q_recommend_history_agg(spark, sf):
    """Candidates scored by the sum of all their similarities to the whole history."""
    found = stored_model(spark, sf).recommend_histories_by_score(customer_histories(spark, sf), 10)
    return found.withColumn("score", F.round("score", 6))


def q_title_search(spark, sf):
    """The fixed searches and the first three letters of every part name, as a table."""
    fixed = spark.createDataFrame([(q,) for q in SEARCHES], "query string")
    asked = fixed.unionByName(table(spark, sf, "part").select(F.substring("p_name", 1, 3).alias("query")))
    return search_titles(identity.build_catalogue(titled(spark, sf)), asked, 10)


def q_json_to_model(spark, sf):
    """From JSON lines with bad ratings and odd timestamps over the filter and the stored table to the answers of a
    model."""
    line = F.col("l_linenumber")
    rows = interactions(spark, sf)
    fields = [
        F.concat(F.lit('"user_id":"'), "reviewerID", F.lit('","asin":"'), "asin", F.lit('"')),
        F.concat(
            F.lit('"rating":'),
            F.when(line == 3, '"abc"').when(line == 4, "null").when(line == 5, F.concat(F.lit('"'), F.col("rating").cast("string"), F.lit(' "'))).otherwise(F.col("rating").cast("string")),
        ),
        F.concat(
            F.lit('"timestamp":'),
            F.when(line == 1, F.concat(F.lit('"'), F.col("timestamp").cast("string"), F.lit('"'))).when(line == 2, F.lit('{"odd":1}')).otherwise(F.col("timestamp").cast("string")),
        ),
    ]
    lines, stored = scratch_path(spark, "odd-reviews"), scratch_path(spark, "odd-table")
    rows.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value")).write.text(lines)
    tables.write_interactions(categories.build_interactions(json_lines.read_reviews(spark, lines), None), stored)
    model = knn_recommender.KnnRecommender.fit(spark.read.parquet(stored), scratch_path(spark, "knn-model"))
    seeds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("seed"))
    return model.recommend(seeds, 10).select("seed", "rank", "asin", six(F.col("score"), "score"), "status")


def q_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


def q_lexicon_sentiment(spark, sf):
    """Every document by the words that tell good from bad documents."""
    docs = table(spark, sf, "documents")
    counts = cut_lineage(sentiment.word_counts(docs, "doc_id", "text"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    scored = sentiment.score_texts(docs, "doc_id", counts, sentiment.learn_lexicon(counts, labels))
    return scored.select(F.col("key").alias("doc_id"), "n_words", "n_hits", six(F.col("score"), "score"))


def q_hybrid_score(spark, sf):
    """Events as reviews: the rating from the number of the item, the value as sentiment."""
    events = event_cells(spark, sf).withColumn("rating", F.lit(1.0) + F.pmod(F.col("asin").cast("int"), F.lit(5)))
    bounds = events.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    both = events.join(F.broadcast(bounds))  # one row
    score = hybrid_score(F.col("rating"), F.col("value"), F.col("lowest"), F.col("highest"))
    return both.select("event_id", six(score, "score"))


def q_recency_confidence(spark, sf):
    rows = interactions(spark, sf)
    latest = rows.agg(F.max("timestamp").alias("latest"))
    age = (F.col("latest") - F.col("timestamp")) / F.lit(86400.0)
    both = rows.join(F.broadcast(latest))  # one row
    return both.select(*ROW_ID, six(recency_confidence(F.col("rating"), age, 365.0), "c"))


def q_category_scoped_metrics(spark, sf):
    """Every item asked for the item of the next number, among all its neighbours of that item's category."""
    model = stored_model(spark, sf)
    codes = model.catalogue.select("item_idx", "asin")
    following = (F.col("asin").cast("int") + 1).cast("string")
    targets = codes.select(F.col("item_idx").alias("query"), following.alias("asin"))
    kinds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("asin"), F.col("p_type").alias("category"))
    near = knn_recommender.best_of_category(model.cells, model.catalogue, targets.withColumnRenamed("query", "item_idx"), kinds, max(KS))
    names = codes.withColumnRenamed("item_idx", "other_idx")
    answers = near.join(names, "other_idx").select(F.col("item_idx").alias("query"), "asin", "score", "other_idx")
    scoped = metrics.best_in_category(answers, targets, kinds, "query", "asin", ["other_idx"], max(KS))
    row = metrics.rank_metrics(metrics.target_ranks(scoped, targets, ["query", "asin"]), KS)
    return row.select("n_evaluated", *[six(F.col(c), c) for c in row.columns if c != "n_evaluated"])


# --- holdouts and metrics ---------------------------------------------------------------


def q_last_interaction(spark, sf):
    rows = interactions(spark, sf).select("reviewerID", "timestamp", *ROW_ID, "rating")
    return holdout.last_interactions(rows, ROW_ID)


def q_eligible_users(spark, sf):
    return holdout.eligible_users(interactions(spark, sf), 40)


def q_eligible_users_distinct(spark, sf):
    return holdout.eligible_users(event_cells(spark, sf), 50, distinct=True)


def q_time_holdout(spark, sf):
    rows = cleaning.min_rating(interactions(spark, sf))
    split = holdout.time_holdout(rows, ROW_ID, 20)
    train = split.train.select("reviewerID", *ROW_ID, F.lit("train").alias("part"))
    return train.unionByName(split.holdout.select("reviewerID", *ROW_ID, F.lit("holdout").alias("part")))


def q_loo_split(spark, sf):
    return holdout.leave_one_out(matrix.rating_matrix(interactions(spark, sf)), n_users=500)


def q_eval_sample(spark, sf):
    users = holdout.eligible_users(interactions(spark, sf)).select("reviewerID")
    return holdout.sample_users(users, 300)


def event_ranks(spark, sf):
    """Every event as one evaluated query; errors found nothing, others ranked 1..100."""
    found = F.when(F.col("category") != "error", F.col("asin").cast("int") + 1)
    return event_cells(spark, sf).withColumn("rank", found)


def q_rank_metrics(spark, sf):
    row = metrics.rank_metrics(event_ranks(spark, sf), KS)
    return row.select("n_evaluated", *[six(F.col(c), c) for c in row.columns if c != "n_evaluated"])


def q_precision_rmse(spark, sf):
    rank = F.col("rank")
    return event_ranks(spark, sf).agg(
        *[six(metrics.precision_at(rank, k), f"precision_at_{k}") for k in KS],
        six(metrics.rmse(F.col("value"), F.col("asin").cast("double")), "rmse"),
    )


def q_random_baseline(spark, sf):
    items = interactions(spark, sf).agg(F.count_distinct("asin").cast("double").alias("n_items"))
    rows = [F.struct(F.lit(k).alias("k"), metrics.random_baseline(F.col("n_items"), k).alias("hit")) for k in KS]
    return items.select(F.explode(F.array(*rows)).alias("r")).select("r.k", F.round("r.hit", 9).alias("hit"))


def known_items(spark, sf):
    """Items with enough reviews; what else a list holds counts as unknown."""
    return cleaning.activity_counts(interactions(spark, sf), "asin").where(F.col("n") >= 28)


def neighbour_lists(spark, sf):
    """The ten neighbours of every item as ranked lists."""
    model = stored_model(spark, sf)
    names = model.catalogue.select(F.col("item_idx").alias("other_idx"), "asin")
    return model.neighbours(10).join(names, "other_idx").select(F.col("item_idx").alias("query"), "asin", "rank")


def q_eval_skips(spark, sf):
    """Every part number is asked for, and an unknown item per supplier; neighbours nobody reviewed often are
    unknown."""
    asked = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("seed"))
    asked = asked.unionByName(supplier_keys(spark, sf, "gone-").withColumnRenamed("key", "seed"))
    answers = cut_lineage(stored_model(spark, sf).recommend(asked, 10).where(F.col("status") == "ok"))
    return metrics.skip_counts(answers, known_items(spark, sf), asked, "seed", "asin")


def q_eval_known_ranks(spark, sf):
    return metrics.drop_unknown_items(neighbour_lists(spark, sf), known_items(spark, sf), "query", "asin")


def q_latency_summary(spark, sf):
    row = quantiles.latency_summary(table(spark, sf, "events"), "value")
    return row.select("n", *[six(F.col(c), c) for c in row.columns if c != "n"])


def q_eval_report(spark, sf):
    row = evaluation.evaluate_knn(stored_model(spark, sf), KS)
    return row.select("n_evaluated", *[six(F.col(c), c) for c in row.columns if c != "n_evaluated"])


def q_eval_report_als(spark, sf):
    path = scratch_path(spark, "als-model")
    return evaluation.evaluate_als(interactions(spark, sf), ROW_ID, path, KS, ALS).drop("train_s", "eval_s")


# --- factor models ------------------------------------------------------------------------


def embedded_items(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_idx"), F.col("embedding").alias("vector")
    )


def event_histories(spark, sf):
    return event_cells(spark, sf).select(F.col("reviewerID").alias("query"), F.col("asin").cast("int").alias("item_idx"))


def q_similar_items(spark, sf):
    near = factors.similar_items(embedded_items(spark, sf), 10)
    return near.select(F.col("query").alias("seed"), "rank", "item_idx", six(F.col("score"), "score"))


def q_gram_matrix(spark, sf):
    return factors.gram_matrix(embedded_items(spark, sf)).select("i", "j", six(F.col("value"), "value"))


def q_factor_top_items(spark, sf):
    """Known users by inner product, what they have seen left out."""
    items = embedded_items(spark, sf)
    seen = event_histories(spark, sf).distinct()
    users = factors.sum_of_items(seen, items)
    top = factors.top_items(users, items, 10, exclude=seen)
    return top.select("query", "rank", "item_idx", six(F.col("score"), "score"))


def q_factor_top_weighted(spark, sf):
    """As factor_top_items, over items of very different lengths and in small blocks, so that bounds leave groups out."""
    length = F.pow(F.lit(1.5), F.col("label"))
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_idx"), F.transform("embedding", lambda x: x.cast("double") * length).alias("vector")
    )
    seen = event_histories(spark, sf).distinct()
    users = factors.sum_of_items(seen, items)
    top = factors.top_items(users, items, 10, exclude=seen, block_size=64)
    return top.select("query", "rank", "item_idx", six(F.col("score"), "score"))


def q_als_foldin(spark, sf):
    """Fold-in vectors put back into their equation: (G + reg I) x must give the item sum."""
    items = embedded_items(spark, sf)
    histories = event_histories(spark, sf)
    gram = factors.gram_array(items)
    reg = ALS.regularization
    solved = factors.fold_in(histories, items, reg, gram)
    import numpy as np

    back = factors.times_matrix(solved, "vector", gram + reg * np.eye(len(gram)))
    sums = factors.sum_vectors(histories.join(items, "item_idx"), "query").withColumnRenamed("vector", "wanted")
    off = F.array_max(F.zip_with("vector", "wanted", lambda a, b: F.abs(a - b)))
    counts = histories.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return back.join(sums, "query").join(counts, "query").select("query", "n", (off < 1e-6).alias("solved"))


def q_als_foldin_recommend(spark, sf):
    items = embedded_items(spark, sf)
    histories = event_histories(spark, sf)
    vectors = factors.fold_in(histories, items, ALS.regularization)
    return factors.top_items(vectors, items, 10, exclude=histories)


def fitted_als(spark, sf):
    return als_recommender.AlsRecommender.fit(titled(spark, sf), scratch_path(spark, "als-model"), ALS)


def q_als_fit(spark, sf):
    """Every user vector must solve its normal equation; single precision allows 1e-3."""
    model = fitted_als(spark, sf)
    parts = model.tables
    checked = als_recommender.equation_residuals(
        parts["cells"], parts["user_factors"], parts["item_factors"], ALS.regularization
    )
    return checked.join(parts["users"], "user_idx").select(
        "reviewerID", "n_cells", (F.col("residual") < 1e-3).alias("solved")
    )


def q_als_report(spark, sf):
    """The report a training run stores: counts, and seconds that add up."""
    path = scratch_path(spark, "als-model")
    als_recommender.AlsRecommender.fit(titled(spark, sf), path, als_recommender.AlsParams(factors=8, iterations=2))
    timed = (F.col("prepare_s") > 0) & (F.col("train_s") > 0) & (F.col("total_s") >= F.col("prepare_s") + F.col("train_s"))
    return spark.read.json(f"{path}/report").select("n_rows", "n_users", "n_items", "n_cells", timed.alias("timed"))


def q_als_plain_fit(spark, sf):
    """With the ridge as given: every item vector must solve its equation for the users returned."""
    params = als_recommender.AlsParams(factors=32, iterations=3, plain_ridge=True)
    model = als_recommender.AlsRecommender.fit(titled(spark, sf), scratch_path(spark, "als-model"), params)
    swapped = model.tables["cells"].select(F.col("item_idx").alias("user_idx"), F.col("user_idx").alias("item_idx"), "c")
    items = model.tables["item_factors"].withColumnRenamed("item_idx", "user_idx")
    users = model.tables["user_factors"].withColumnRenamed("user_idx", "item_idx")
    checked = als_recommender.equation_residuals(swapped, items, users, params.regularization, plain=True)
    return checked.join(model.tables["catalogue"], checked["user_idx"] == F.col("item_idx")).select(
        "asin", "n_cells", (F.col("residual") < 1e-6).alias("solved")
    )


def q_als_recommend_user(spark, sf):
    model = fitted_als(spark, sf)
    return model.recommend_users(model.tables["users"], 10)


def checked_answers(answers, queries, items, seen):
    """(query, n, n_seen, exact) of ranked answers: how many, how many of them excluded pairs, and whether every
    score is the product of its vectors and the ranks follow the scores."""
    vectors = answers.join(queries.select("query", F.col("vector").alias("x")), "query").join(
        items.select("item_idx", F.col("vector").alias("y")), "item_idx"
    )
    # Where both vectors are at hand only their product goes on.
    vectors = vectors.select("query", "item_idx", "rank", "score", dot(F.col("x"), F.col("y")).alias("product"))
    before = F.lag("score").over(Window.partitionBy("query").orderBy("rank"))
    right = (F.abs(F.col("score") - F.col("product")) < 1e-6) & F.coalesce(before >= F.col("score"), F.col("rank") == 1)
    flagged = vectors.withColumn("right", right).join(
        seen.select("query", "item_idx").distinct().withColumn("known", F.lit(True)), ["query", "item_idx"], "left"
    )
    return flagged.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.count("known").alias("n_seen"), F.every("right").alias("exact")
    )


def q_als_recommend_checked(spark, sf):
    """Answers for every trained user against the stored factors and cells."""
    model = fitted_als(spark, sf)
    parts = model.tables
    answers = cut_lineage(model.recommend_users(parts["users"], 10))
    checked = checked_answers(
        answers,
        parts["user_factors"].withColumnRenamed("user_idx", "query"),
        parts["item_factors"],
        parts["cells"].withColumnRenamed("user_idx", "query"),
    )
    return checked.join(parts["users"].withColumnRenamed("user_idx", "query"), "query").select("reviewerID", "n", "n_seen", "exact")


def q_als_similar_checked(spark, sf):
    """Similar items of every trained item against the stored factors."""
    model = fitted_als(spark, sf)
    near = cut_lineage(factors.similar_items(model.tables["item_factors"], 5))
    units = factors.unit_length(model.tables["item_factors"], "vector")
    itself = units.select(F.col("item_idx").alias("query"), "item_idx")
    checked = checked_answers(near, units.withColumnRenamed("item_idx", "query"), units, itself)
    names = model.tables["catalogue"].select(F.col("item_idx").alias("query"), "asin")
    return checked.join(names, "query").select("asin", "n", "n_seen", "exact")


def q_als_foldin_recommend_checked(spark, sf):
    """Answers for histories outside the model; als_foldin checks the vectors themselves."""
    items, histories = embedded_items(spark, sf), event_histories(spark, sf)
    vectors = cut_lineage(factors.fold_in(histories, items, ALS.regularization))
    answers = cut_lineage(factors.top_items(vectors, items, 10, exclude=histories))
    return checked_answers(answers, vectors, items, histories)


def q_eval_report_als_counts(spark, sf):
    """What of the report SQL can tell; of the metrics, that they are shares and grow with K."""
    path = scratch_path(spark, "als-model")
    row = evaluation.evaluate_als(interactions(spark, sf), ROW_ID, path, KS, ALS)
    grows = F.lit(True)
    for low, high in zip(KS, KS[1:]):
        grows &= (F.col(f"hit_at_{low}") <= F.col(f"hit_at_{high}")) & (F.col(f"ndcg_at_{low}") <= F.col(f"ndcg_at_{high}"))
    shares = (F.col(f"hit_at_{KS[-1]}") <= 1) & (F.col(f"mrr_at_{KS[-1]}") <= F.col(f"hit_at_{KS[-1]}"))
    counts = ["n_users", "n_items", "nnz_train", "n_already_seen", "n_evaluated"]
    return row.select(*counts, (grows & shares).alias("plausible"))


def q_als_similar(spark, sf):
    seeds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("seed"))
    return fitted_als(spark, sf).similar(seeds, 5)


def entry(spark: SparkSession) -> DataFrame:
    """Neighbour recommendations for every part, from raw order lines."""
    return q_recommend_seed(spark, "/root/testdata/sf0.001")


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm is None:
        return library_queries()
    return {**library_queries(), **llm.QUERIES, "pipeline": corpus_pipeline.run}


# --- the same queries as SQL --------------------------------------------------------------

INTER = """inter AS (
  SELECT CAST(o_custkey AS VARCHAR) AS reviewerID, CAST(l_partkey AS VARCHAR) AS asin,
         CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
         l_returnflag || ' ' || l_linestatus AS reviewText,
         CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp",
         l_orderkey, l_linenumber, l_partkey, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
META = """meta AS (
  SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS product_title, p_type AS main_category FROM part
  WHERE p_type <> 'PROMO')"""
EVENTS = """ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS reviewerID, json_extract_string(props, '$.k') AS asin,
         event_type AS category, value FROM events)"""
CELLS = "cells AS (SELECT reviewerID, asin, sum(rating) AS w FROM inter GROUP BY ALL)"
IDS = """ids AS (
  SELECT asin, CAST(row_number() OVER (ORDER BY md5(asin), asin) - 1 AS INTEGER) AS item_idx
  FROM (SELECT DISTINCT asin FROM inter))"""
PAIRS = """norms AS (SELECT asin, sqrt(sum(w * w)) AS norm FROM cells GROUP BY asin),
vec AS (SELECT reviewerID, item_idx, w / norm AS x FROM cells JOIN norms USING (asin) JOIN ids USING (asin)),
sims AS (SELECT l.item_idx, r.item_idx AS other_idx, round(sum(l.x * r.x), 9) AS score
         FROM vec l JOIN vec r ON l.reviewerID = r.reviewerID AND l.item_idx <> r.item_idx
         GROUP BY l.item_idx, r.item_idx),
near AS (SELECT item_idx, other_idx, score,
                CAST(row_number() OVER (PARTITION BY item_idx ORDER BY score DESC, other_idx) AS INTEGER) AS rank
         FROM sims)"""
KNOWN = "known AS (SELECT asin FROM inter GROUP BY asin HAVING count(*) >= 28)"
ANSWERED = """asked AS (SELECT DISTINCT reviewerID AS query, 'no_neighbours' AS status FROM inter
  UNION ALL SELECT 'gone-' || s_suppkey, 'not_found' FROM supplier)
SELECT asked.query, CAST(rank AS INTEGER) AS rank, asin, item_idx,
  CASE WHEN rank IS NOT NULL THEN coalesce(title, 'Unknown Product') END AS title, round(score, 6) AS score,
  CASE WHEN rank IS NULL THEN status ELSE 'ok' END AS status
FROM asked LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.query = asked.query LEFT JOIN cat ON cat.item_idx = other_idx"""
ROWS = "l_orderkey, l_linenumber, l_partkey, l_quantity"
SEVEN = 'reviewerID, asin, rating, reviewText, "timestamp", product_title, main_category'


def core_filter_sql(users: int, items: int) -> str:
    return f"""WITH {INTER.replace("inter AS", "complete AS", 1)}, {META},
inter AS (SELECT * REPLACE (CASE WHEN reviewText = 'R F' AND l_linenumber = 7 THEN NULL ELSE reviewerID END AS reviewerID,
    CASE WHEN reviewText = 'A F' AND l_linenumber = 6 THEN NULL ELSE asin END AS asin), asin AS joined FROM complete),
u AS (SELECT reviewerID FROM inter GROUP BY 1 HAVING count(*) >= {users}),
i AS (SELECT asin FROM inter GROUP BY 1 HAVING count(*) >= {items})
SELECT {SEVEN} FROM inter LEFT JOIN meta ON joined = parent_asin
WHERE reviewerID IN (SELECT reviewerID FROM u) AND asin IN (SELECT asin FROM i)"""


def metric_sql(ks: list[int]) -> str:
    parts = ["count(*) AS n_evaluated"]
    for k in ks:
        parts.append(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_{k}")
        parts.append(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_{k}")
    parts.append(f"round(avg(CASE WHEN rank <= {max(ks)} THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_at_{max(ks)}")
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return library_sql()
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**library_sql(), **llm.ORACLES, **whole}


def library_sql() -> dict[str, str]:
    meta_lines = """lines AS (
  SELECT p_partkey, p_type, CASE WHEN p_type <> 'ECONOMY' THEN p_name END AS title FROM part)"""
    embedded = """emb AS (
  SELECT CAST(vec_id AS INTEGER) AS item_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
    weighted = """emb AS (
  SELECT CAST(vec_id AS INTEGER) AS item_idx, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * pow(1.5, label)) AS v FROM embeddings)"""
    event_ranked = f"{EVENTS}, ranked AS (SELECT *, CASE WHEN category <> 'error' THEN CAST(asin AS INTEGER) + 1 END AS rank FROM ev)"
    asked = " UNION ALL ".join(f"SELECT '{q}' AS query" for q in SEARCHES)
    titled_ids = f"{INTER}, {META}, {IDS}, cat AS (SELECT asin, item_idx, product_title AS title FROM ids LEFT JOIN meta ON asin = parent_asin)"
    return {
        "load_reviews": f'WITH {INTER} SELECT reviewerID, asin, rating, reviewText, "timestamp", asin AS parent_asin FROM inter',
        "load_reviews_limit": """SELECT p_brand AS reviewerID, CAST(p_partkey AS VARCHAR) AS asin,
  CAST(p_size AS VARCHAR) AS rating, p_name AS reviewText, p_partkey AS "timestamp"
FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100) WHERE p_type <> 'PROMO'""",
        "load_meta": f"""WITH {meta_lines} SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, title AS product_title,
  p_type AS main_category FROM lines WHERE p_type <> 'PROMO'""",
        # 300 lines are the three lines of the first 100 parts.
        "load_meta_limit": f"""WITH {meta_lines} SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, title AS product_title,
  p_type AS main_category FROM (SELECT * FROM lines ORDER BY p_partkey LIMIT 100) WHERE p_type <> 'PROMO'""",
        "build_meta_cache": f"""WITH {meta_lines} SELECT CAST(p_partkey AS VARCHAR) AS parent_asin,
  title AS product_title, p_type AS main_category FROM lines""",
        "load_shards": f"""WITH {INTER} SELECT asin, count(*) AS n, sum(rating) AS total FROM inter
WHERE NOT (reviewText[1] = 'R' AND l_linenumber = 7) GROUP BY asin""",
        "write_interactions": f"WITH {INTER}, {META} SELECT {SEVEN} FROM inter LEFT JOIN meta ON asin = parent_asin",
        "multi_category_build": f"""WITH {INTER}, {META},
r AS (SELECT inter.*, product_title, main_category, main_category AS category FROM inter JOIN meta ON asin = parent_asin),
u AS (SELECT category, reviewerID FROM r GROUP BY ALL HAVING count(*) >= 6),
i AS (SELECT category, asin FROM r GROUP BY ALL HAVING count(*) >= 11)
SELECT category, {SEVEN} FROM r SEMI JOIN u USING (category, reviewerID) SEMI JOIN i USING (category, asin)""",
        "explode_categories": """WITH n AS (SELECT DISTINCT p_brand || ' ' || p_type AS name, p_type FROM part)
SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS position, name, name || '.jsonl' AS review_file,
  CASE WHEN p_type <> 'PROMO' THEN 'meta_' || name || '.jsonl' END AS meta_file,
  replace(name, ' ', '_') AS safe_name, p_type <> 'PROMO' AS is_valid FROM n""",
        "run_report": f"""WITH {EVENTS} SELECT category, count(*) AS n_rows, count(DISTINCT reviewerID) AS n_users,
  round(sum(value), 2) AS total_s FROM ev GROUP BY category""",
        "category_report": f"""WITH {INTER}, {META},
r AS (SELECT reviewerID, asin, main_category AS category FROM inter JOIN meta ON asin = parent_asin),
u AS (SELECT category, reviewerID FROM r GROUP BY ALL HAVING count(*) >= 6),
i AS (SELECT category, asin FROM r GROUP BY ALL HAVING count(*) >= 11),
k AS (SELECT category, count(*) AS n FROM r SEMI JOIN u USING (category, reviewerID) SEMI JOIN i USING (category, asin) GROUP BY 1)
SELECT category, 'success' AS status, coalesce(n, 0) AS n_rows FROM (SELECT DISTINCT main_category AS category FROM meta) LEFT JOIN k USING (category)""",
        "recommender_roundtrip": f"""WITH {INTER}, {CELLS}
SELECT 'n_users' AS metric, count(DISTINCT reviewerID) AS v FROM cells
UNION ALL SELECT 'n_items', count(DISTINCT asin) FROM cells UNION ALL SELECT 'n_cells', count(*) FROM cells""",
        "coerce_rating": f"""WITH {INTER} SELECT {ROWS},
  CASE l_linenumber WHEN 1 THEN 4.0 WHEN 2 THEN 5.0 ELSE rating END AS rating
FROM inter WHERE l_linenumber NOT IN (3, 4, 5, 6)""",
        "min_rating": f'WITH {INTER} SELECT reviewerID, asin, rating, "timestamp" FROM inter WHERE rating >= 4',
        "confidence": f"WITH {INTER} SELECT {ROWS}, 1 + 40 * rating AS c FROM inter",
        "join_meta": f"""WITH {INTER}, {META} SELECT {SEVEN}, asin AS parent_asin FROM inter LEFT JOIN meta ON asin = meta.parent_asin""",
        "core_filter": core_filter_sql(6, 11),
        "core_filter_strict": core_filter_sql(30, 28),
        "dedup_meta": f"""WITH {EVENTS} SELECT asin, category, value FROM ev
QUALIFY row_number() OVER (PARTITION BY asin ORDER BY event_id) = 1""",
        "user_item_counts": f"""WITH {INTER} SELECT 'user' AS kind, reviewerID AS id, count(*) AS n FROM inter GROUP BY 2
UNION ALL SELECT 'item', asin, count(*) FROM inter GROUP BY 2""",
        "global_ids": f"""WITH {INTER}, {EVENTS}, {META} SELECT asin FROM inter UNION SELECT asin FROM ev
UNION SELECT parent_asin FROM meta""",
        "encode_ids": f"""WITH {INTER}, {IDS}, uids AS (
  SELECT reviewerID, CAST(row_number() OVER (ORDER BY md5(reviewerID), reviewerID) - 1 AS INTEGER) AS user_idx
  FROM (SELECT DISTINCT reviewerID FROM inter))
SELECT {ROWS}, user_idx, item_idx, rating FROM inter JOIN uids USING (reviewerID) JOIN ids USING (asin)""",
        "catalogue": f"WITH {titled_ids} SELECT asin, item_idx, title FROM cat",
        "interaction_matrix": f"WITH {INTER}, {CELLS} SELECT reviewerID, asin, w FROM cells",
        "confidence_matrix": f"""WITH {INTER} SELECT reviewerID, asin, sum(1 + 40 * rating) AS c FROM inter
WHERE rating >= 4 GROUP BY ALL""",
        "item_norms": f"WITH {INTER}, {CELLS} SELECT asin, round(sqrt(sum(w * w)), 6) AS norm FROM cells GROUP BY asin",
        "dataset_profile": f"""WITH {INTER} SELECT 'n_interactions' AS metric, count(*) AS value FROM inter
UNION ALL SELECT 'n_pairs', count(*) FROM (SELECT DISTINCT reviewerID, asin FROM inter)
UNION ALL SELECT 'n_users', count(DISTINCT reviewerID) FROM inter
UNION ALL SELECT 'n_items', count(DISTINCT asin) FROM inter
UNION ALL SELECT 'n_eligible_users', count(*) FROM (SELECT 1 FROM inter GROUP BY reviewerID HAVING count(*) >= 5)""",
        "item_knn": f"""WITH {INTER}, {CELLS}, {IDS}, {PAIRS}
SELECT item_idx, rank, other_idx, round(score, 6) AS score FROM near WHERE rank <= 10""",
        "recommend_seed": f"""WITH {INTER.replace("inter AS", "ordered AS", 1)}, {META},
lonely AS (SELECT 'lonely-' || s_suppkey AS key FROM supplier),
inter AS (SELECT reviewerID, asin, rating FROM ordered UNION ALL SELECT key, key, 5.0 FROM lonely),
{IDS}, {CELLS}, {PAIRS},
cat AS (SELECT asin, item_idx, coalesce(product_title, 'Unknown Product') AS title FROM ids LEFT JOIN meta ON asin = parent_asin),
asked AS (SELECT CAST(p_partkey AS VARCHAR) AS seed FROM part UNION SELECT key FROM lonely
  UNION SELECT 'gone-' || s_suppkey FROM supplier)
SELECT seed, s.title AS seed_title, rank, c.asin, c.title, round(score, 6) AS score,
  CASE WHEN s.asin IS NULL THEN 'not_found' WHEN rank IS NULL THEN 'no_neighbours' ELSE 'ok' END AS status
FROM asked LEFT JOIN cat s ON seed = s.asin LEFT JOIN (SELECT * FROM near WHERE rank <= 10) near ON near.item_idx = s.item_idx
LEFT JOIN cat c ON c.item_idx = other_idx""",
        "recommend_history_first": f"""WITH {titled_ids}, {CELLS}, {PAIRS},
hist AS (SELECT reviewerID AS query, item_idx,
  row_number() OVER (PARTITION BY reviewerID ORDER BY "timestamp", {ROWS}) AS pos FROM inter JOIN ids USING (asin)),
first AS (SELECT query, item_idx FROM hist WHERE pos = 1),
ranked AS (SELECT query, other_idx, score, row_number() OVER (PARTITION BY query ORDER BY near.rank) AS rank
  FROM first JOIN near USING (item_idx)
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.query = first.query AND h.item_idx = near.other_idx)),
{ANSWERED}""",
        "recommend_history_agg": f"""WITH {titled_ids}, {CELLS}, {PAIRS},
hist AS (SELECT DISTINCT reviewerID AS query, item_idx FROM inter JOIN ids USING (asin)),
scored AS (SELECT query, other_idx, sum(CAST(round(score * 1e9) AS BIGINT)) / 1e9 AS score
  FROM hist JOIN near USING (item_idx) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other_idx) AS rank FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.query = s.query AND h.item_idx = s.other_idx)),
{ANSWERED}""",
        "knn_refresh": f"""WITH {INTER}, {CELLS}, {IDS}, {PAIRS}
SELECT item_idx, rank, other_idx, round(score, 6) AS score FROM near WHERE rank <= 10""",
        "json_to_model": f"""WITH {INTER.replace("inter AS", "complete AS", 1)},
u AS (SELECT reviewerID FROM complete GROUP BY 1 HAVING count(*) >= 6),
i AS (SELECT asin FROM complete GROUP BY 1 HAVING count(*) >= 11),
inter AS (SELECT * FROM complete SEMI JOIN u USING (reviewerID) SEMI JOIN i USING (asin) WHERE l_linenumber NOT IN (3, 4)),
{IDS}, {CELLS}, {PAIRS}
SELECT CAST(p_partkey AS VARCHAR) AS seed, rank, o.asin, round(score, 6) AS score,
  CASE WHEN s.asin IS NULL THEN 'not_found' WHEN rank IS NULL THEN 'no_neighbours' ELSE 'ok' END AS status
FROM part LEFT JOIN ids s ON s.asin = CAST(p_partkey AS VARCHAR)
LEFT JOIN (SELECT * FROM near WHERE rank <= 10) near ON near.item_idx = s.item_idx LEFT JOIN ids o ON o.item_idx = other_idx""",
        "clean_text": """SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g')) AS cleaned FROM documents""",
        "lexicon_sentiment": r"""WITH c AS (SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL),
w AS (SELECT word, sum(n) AS n, coalesce(sum(n) FILTER (quality = 1), 0) AS n1, coalesce(sum(n) FILTER (quality = 0), 0) AS n0
  FROM c LEFT JOIN labels USING (doc_id) GROUP BY word),
a AS (SELECT *, 1000.0::DOUBLE * n / sum(n) OVER () AS a, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0 FROM w),
z AS (SELECT word, ln((n1 + a) / (t1 + 1000 - n1 - a)) - ln((n0 + a) / (t0 + 1000 - n0 - a)) AS weight,
  sqrt(1 / (n1 + a) + 1 / (n0 + a)) AS error FROM a),
s AS (SELECT doc_id, sum(n) AS n_words, sum(n) FILTER (weight IS NOT NULL) AS n_hits, sum(n * weight) AS total
  FROM c LEFT JOIN (SELECT word, weight FROM z WHERE abs(weight / error) >= 1.96) USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hits, 0)::BIGINT AS n_hits,
  round(coalesce(total / n_hits, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id)""",
        "hybrid_score": f"""WITH {EVENTS}, b AS (SELECT min(value) AS low, max(value) AS high FROM ev)
SELECT event_id, round(0.7::DOUBLE * (1 + CAST(asin AS INTEGER) % 5) + 0.3::DOUBLE * (1 + 4 * (value - low) / (high - low)), 6) AS score
FROM ev, b""",
        "recency_confidence": f"""WITH {INTER}, l AS (SELECT max("timestamp") AS latest FROM inter)
SELECT {ROWS}, round((1 + 40 * rating) * exp(-((latest - "timestamp") / 86400.0::DOUBLE) / 365.0::DOUBLE), 6) AS c FROM inter, l""",
        "category_scoped_metrics": f"""WITH {INTER}, {CELLS}, {IDS}, {PAIRS},
kinds AS (SELECT CAST(p_partkey AS VARCHAR) AS asin, p_type AS category FROM part),
targets AS (SELECT item_idx AS query, CAST(CAST(asin AS INTEGER) + 1 AS VARCHAR) AS asin FROM ids),
wanted AS (SELECT query, category FROM targets JOIN kinds USING (asin)),
scoped AS (SELECT n.item_idx AS query, i.asin, row_number() OVER (PARTITION BY n.item_idx ORDER BY n.rank) AS rank
  FROM near n JOIN ids i ON i.item_idx = n.other_idx JOIN kinds k ON k.asin = i.asin
  JOIN wanted w ON w.query = n.item_idx AND w.category = k.category),
ranked AS (SELECT t.query, s.rank FROM targets t LEFT JOIN scoped s ON s.query = t.query AND s.asin = t.asin)
SELECT {metric_sql(KS)} FROM ranked""",
        "title_search": f"""WITH {titled_ids}, q AS (SELECT * FROM ({asked}) UNION SELECT p_name[1:3] FROM part),
m AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY item_idx) AS INTEGER) AS pos, asin, item_idx, title
  FROM q JOIN cat ON contains(lower(title), lower(query)))
SELECT * FROM m WHERE pos <= 10""",
        "last_interaction": f"""WITH {INTER} SELECT reviewerID, count(*) OVER (PARTITION BY reviewerID) AS n_rows,
  "timestamp", {ROWS}, rating FROM inter
QUALIFY row_number() OVER (PARTITION BY reviewerID ORDER BY "timestamp" DESC, {ROWS}) = 1""",
        "eligible_users": f"WITH {INTER} SELECT reviewerID, count(*) AS n FROM inter GROUP BY 1 HAVING count(*) >= 40",
        "eligible_users_distinct": f"""WITH {EVENTS} SELECT reviewerID, count(DISTINCT asin) AS n FROM ev GROUP BY 1
HAVING count(DISTINCT asin) >= 50""",
        "time_holdout": f"""WITH {INTER}, r AS (
  SELECT *, row_number() OVER (PARTITION BY reviewerID ORDER BY "timestamp" DESC, {ROWS}) AS rn,
         count(*) OVER (PARTITION BY reviewerID) AS n FROM inter WHERE rating >= 4)
SELECT reviewerID, {ROWS}, CASE WHEN rn = 1 THEN 'holdout' ELSE 'train' END AS part FROM r WHERE rn > 1 OR n >= 20""",
        "loo_split": f"""WITH {INTER}, {CELLS},
u AS (SELECT reviewerID FROM cells GROUP BY 1 HAVING count(*) >= 5 ORDER BY md5('42-' || reviewerID), 1 LIMIT 500)
SELECT reviewerID, asin, CAST(pos AS INTEGER) AS pos FROM (
  SELECT reviewerID, asin, row_number() OVER (PARTITION BY reviewerID
    ORDER BY md5('42-' || reviewerID || '-' || asin), asin) - 1 AS pos FROM cells SEMI JOIN u USING (reviewerID))""",
        "eval_sample": f"""WITH {INTER} SELECT reviewerID FROM inter GROUP BY 1 HAVING count(*) >= 5
ORDER BY md5('42-' || reviewerID), 1 LIMIT 300""",
        "rank_metrics": f"WITH {event_ranked} SELECT {metric_sql(KS)} FROM ranked",
        "precision_rmse": f"""WITH {event_ranked} SELECT """
        + ", ".join(
            f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) / {k}, 6) AS precision_at_{k}" for k in KS
        )
        + ", round(sqrt(avg((value - CAST(asin AS DOUBLE)) * (value - CAST(asin AS DOUBLE)))), 6) AS rmse FROM ranked",
        "random_baseline": f"""WITH {INTER}, n AS (SELECT count(DISTINCT asin) AS n FROM inter)
SELECT CAST(k AS INTEGER) AS k, round(k::DOUBLE / n, 9) AS hit FROM n, (SELECT unnest([5, 10, 20]) AS k)""",
        "eval_skips": f"""WITH {titled_ids}, {CELLS}, {PAIRS}, {KNOWN}
SELECT 'queries' AS what, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n
UNION ALL SELECT 'skipped_inference', count(*) + (SELECT count(*) FROM supplier) FROM part
  WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT asin FROM ids JOIN near USING (item_idx))
UNION ALL SELECT 'skipped_unknown_item', count(*) FROM near JOIN ids ON other_idx = ids.item_idx
  WHERE rank <= 10 AND asin NOT IN (SELECT asin FROM known)""",
        "eval_known_ranks": f"""WITH {INTER}, {CELLS}, {IDS}, {PAIRS}, {KNOWN}
SELECT near.item_idx AS query, asin,
  CAST(row_number() OVER (PARTITION BY near.item_idx ORDER BY near.rank) AS INTEGER) AS rank
FROM near JOIN ids ON other_idx = ids.item_idx WHERE near.rank <= 10 AND asin IN (SELECT asin FROM known)""",
        "latency_summary": """SELECT count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS "min",
  round(max(value), 6) AS "max", round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events""",
        "eval_report": f"""WITH {INTER}, {CELLS}, {IDS}, {PAIRS},
u AS (SELECT reviewerID FROM cells GROUP BY 1 HAVING count(*) >= 5 ORDER BY md5('42-' || reviewerID), 1 LIMIT 1000),
loo AS (SELECT reviewerID AS query, item_idx, row_number() OVER (PARTITION BY reviewerID
    ORDER BY md5('42-' || reviewerID || '-' || asin), asin) - 1 AS pos
  FROM cells SEMI JOIN u USING (reviewerID) JOIN ids USING (asin)),
hist AS (SELECT * FROM loo WHERE pos >= 1),
answers AS (SELECT query, other_idx, row_number() OVER (PARTITION BY query ORDER BY near.rank) AS rank
  FROM hist f JOIN near USING (item_idx)
  WHERE f.pos = 1 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.query = f.query AND h.item_idx = near.other_idx)),
ranked AS (SELECT loo.query, CASE WHEN rank <= 20 THEN rank END AS rank FROM loo
  LEFT JOIN answers a ON a.query = loo.query AND a.other_idx = loo.item_idx WHERE pos = 0)
SELECT {metric_sql(KS)} FROM ranked""",
        "similar_items": f"""WITH {embedded},
s AS (SELECT l.item_idx AS seed, r.item_idx, round(list_cosine_similarity(l.v, r.v), 9) AS score
  FROM emb l JOIN emb r ON l.item_idx <> r.item_idx),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, item_idx) AS INTEGER) AS rank FROM s)
SELECT seed, rank, item_idx, round(score, 6) AS score FROM k WHERE rank <= 10""",
        "gram_matrix": """WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
  generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS value
FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""",
        "factor_top_items": f"""WITH {EVENTS}, {embedded},
seen AS (SELECT DISTINCT reviewerID AS query, CAST(asin AS INTEGER) AS item_idx FROM ev),
parts AS (SELECT query, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM seen JOIN emb USING (item_idx)),
sums AS (SELECT query, i, sum(x) AS x FROM parts GROUP BY ALL),
users AS (SELECT query, list(x ORDER BY i) AS v FROM sums GROUP BY query),
s AS (SELECT query, item_idx, round(list_dot_product(u.v, e.v), 9) AS score FROM users u, emb e
  WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.query = u.query AND seen.item_idx = e.item_idx)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_idx) AS INTEGER) AS rank FROM s)
SELECT query, rank, item_idx, round(score, 6) AS score FROM k WHERE rank <= 10""",
        "factor_top_weighted": f"""WITH {EVENTS}, {weighted},
seen AS (SELECT DISTINCT reviewerID AS query, CAST(asin AS INTEGER) AS item_idx FROM ev),
parts AS (SELECT query, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM seen JOIN emb USING (item_idx)),
sums AS (SELECT query, i, sum(x) AS x FROM parts GROUP BY ALL),
users AS (SELECT query, list(x ORDER BY i) AS v FROM sums GROUP BY query),
s AS (SELECT query, item_idx, round(list_dot_product(u.v, e.v), 9) AS score FROM users u, emb e
  WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.query = u.query AND seen.item_idx = e.item_idx)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_idx) AS INTEGER) AS rank FROM s)
SELECT query, rank, item_idx, round(score, 6) AS score FROM k WHERE rank <= 10""",
        "als_recommend_checked": f"""WITH {INTER}, pairs AS (SELECT DISTINCT reviewerID, asin FROM inter WHERE rating >= 4)
SELECT reviewerID, least(10, (SELECT count(DISTINCT asin) FROM pairs) - count(*)) AS n, 0 AS n_seen, true AS exact
FROM pairs GROUP BY reviewerID""",
        "als_similar_checked": f"""WITH {INTER}, items AS (SELECT DISTINCT asin FROM inter WHERE rating >= 4)
SELECT asin, least(5, (SELECT count(*) FROM items) - 1) AS n, 0 AS n_seen, true AS exact FROM items""",
        "als_foldin_recommend_checked": f"""WITH {EVENTS},
pairs AS (SELECT DISTINCT reviewerID AS query, CAST(asin AS INTEGER) AS item_idx FROM ev WHERE asin IS NOT NULL)
SELECT query, least(10, (SELECT count(*) FROM embeddings) - count(*) FILTER (WHERE item_idx IN (SELECT vec_id FROM embeddings))) AS n,
  0 AS n_seen, true AS exact FROM pairs GROUP BY query""",
        "eval_report_als_counts": f"""WITH {INTER}, r AS (
  SELECT *, row_number() OVER (PARTITION BY reviewerID ORDER BY "timestamp" DESC, {ROWS}) AS rn,
         count(*) OVER (PARTITION BY reviewerID) AS n FROM inter WHERE rating >= 4 AND "timestamp" IS NOT NULL),
train AS (SELECT DISTINCT reviewerID, asin FROM r WHERE rn > 1),
targets AS (SELECT reviewerID, asin FROM r WHERE rn = 1 AND n >= 5 ORDER BY md5('42-' || reviewerID), 1 LIMIT 1000)
SELECT (SELECT count(DISTINCT reviewerID) FROM r) AS n_users, (SELECT count(DISTINCT asin) FROM r) AS n_items,
  (SELECT count(*) FROM train) AS nnz_train, (SELECT count(*) FROM targets SEMI JOIN train USING (reviewerID, asin)) AS n_already_seen,
  (SELECT count(*) FROM targets) AS n_evaluated, true AS plausible""",
        "als_foldin": f"WITH {EVENTS} SELECT reviewerID AS query, count(*) AS n, true AS solved FROM ev GROUP BY 1",
        "als_plain_fit": f"""WITH {INTER} SELECT asin, count(DISTINCT reviewerID) AS n_cells, true AS solved FROM inter
WHERE rating >= 4 GROUP BY 1""",
        "als_report": f"""WITH {INTER} SELECT count(*) AS n_rows, count(DISTINCT reviewerID) AS n_users, count(DISTINCT asin) AS n_items,
count(DISTINCT (reviewerID, asin)) AS n_cells, true AS timed FROM inter WHERE rating >= 4""",
        "als_fit": f"""WITH {INTER} SELECT reviewerID, count(DISTINCT asin) AS n_cells, true AS solved FROM inter
WHERE rating >= 4 GROUP BY 1""",
    }
