import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmate.operators import holdout, identity, metrics, profile, quantiles
from shelfmate.operators.search import rarest_grams, search_titles, title_index


@pytest.fixture(scope="module")
def catalogue(spark):
    titles = ["Red Drill", "DRILL bit 50%", "saw", None, "50_pack"]
    return spark.createDataFrame([(f"a{i}", i, t) for i, t in enumerate(titles)], "asin string, item_idx int, title string")


def test_search_is_literal_and_ordered(catalogue):
    got = rows(search_titles(catalogue.repartition(3), ["drill", "50%", "_", "none"]), "query", "pos", "item_idx")
    assert got == [("50%", 1, 1), ("_", 1, 4), ("drill", 1, 0), ("drill", 2, 1)]
    assert rows(search_titles(catalogue, ["DRILL"], limit=1), "item_idx") == [(0,)]


def test_queries_that_begin_alike_use_their_rarest_gram(spark, tmp_path):
    titles = [f"the part {chr(97 + i % 26)}{i:04d}x" for i in range(2000)]
    catalogue = spark.createDataFrame([(f"a{i}", i, t) for i, t in enumerate(titles)], "asin string, item_idx int, title string")
    title_index(catalogue).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    queries = [f"The part {chr(97 + i % 26)}{i:04d}" for i in range(0, 400, 7)] + ["the", "the part zz"]
    want = sorted(
        (q, pos + 1, i) for q in queries for pos, i in enumerate([i for i, t in enumerate(titles) if q.lower() in t][:10])
    )
    for index in (None, stored):
        assert rows(search_titles(catalogue, queries, 10, index), "query", "pos", "item_idx") == sorted(want, key=repr)
    asked = spark.createDataFrame([(q, q.lower()) for q in queries], "query string, _low string")
    chosen, _ = rarest_grams(asked, stored)
    met = {r["query"]: r.n for r in chosen.collect()}
    assert met.pop("the") == 2000 and "the part zz" not in met
    assert len(met) == 58 and max(met.values()) <= 210  # the first three letters would meet all 2,000 titles each


@pytest.mark.parametrize("queries, limit", [(["a"], 0), (["a"], 51), ([""], 10)])
def test_search_bounds(catalogue, queries, limit):
    with pytest.raises(ValueError):
        search_titles(catalogue, queries, limit)


def test_codes_are_dense_and_stable(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "asin string")
    one = rows(identity.dense_codes(keys.repartition(1), "asin", "idx"))
    many = rows(identity.dense_codes(keys.repartition(13), "asin", "idx"))
    assert one == many
    assert sorted(r[1] for r in one) == list(range(5000))


def test_distinct_keys_over_shards(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "asin string")
    b = spark.createDataFrame([("y",), ("z",)], "asin string")
    assert rows(identity.distinct_keys([a, b], "asin")) == [("x",), ("y",), ("z",)]


HISTORY = [("a", "p", t, i) for i, t in enumerate([1, 2, 3, 4, 4])] + [("b", "p", 1, 10), ("b", "p", 2, 11), ("c", "q", 5, 20)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_time_holdout(spark, partitions):
    df = spark.createDataFrame(HISTORY, "reviewerID string, asin string, timestamp long, id int").repartition(partitions)
    split = holdout.time_holdout(df, ["id"], 5)
    assert rows(split.holdout, "reviewerID", "id", "n_rows") == [("a", 3, 5)]
    assert rows(split.train, "id") == [(0,), (1,), (10,), (2,), (4,)]
    assert rows(holdout.last_interactions(df, ["id"]), "reviewerID", "id") == [("a", 3), ("b", 11), ("c", 20)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_holdout_with_timestamps(spark, kind):
    df = spark.createDataFrame(HISTORY, "reviewerID string, asin string, timestamp long, id int")
    df = df.withColumn("timestamp", F.timestamp_seconds("timestamp").cast(kind))
    assert rows(holdout.last_interactions(df, ["id"]), "reviewerID", "id") == [("a", 3), ("b", 11), ("c", 20)]


def test_eligible_users_rows_or_items(spark):
    df = spark.createDataFrame(HISTORY, "reviewerID string, asin string, timestamp long, id int")
    assert rows(holdout.eligible_users(df, 2), "reviewerID") == [("a",), ("b",)]
    assert rows(holdout.eligible_users(df, 2, distinct=True), "reviewerID") == []


def test_leave_one_out(spark):
    cells = spark.createDataFrame(
        [(f"u{u}", f"i{i}") for u in range(20) for i in range(u)], "reviewerID string, asin string"
    )
    split = holdout.leave_one_out(cells, n_users=8, min_history=5, max_history=7)
    again = holdout.leave_one_out(cells.repartition(5), n_users=8, min_history=5, max_history=7)
    assert rows(split) == rows(again)
    per_user = {r.reviewerID: r for r in split.groupBy("reviewerID").agg(F.count("*").alias("n"), F.min("pos").alias("lo")).collect()}
    assert len(per_user) == 8
    assert all(r.lo == 0 and r.n == min(8, int(u[1:])) for u, r in per_user.items())
    whole = holdout.leave_one_out(cells, n_users=8, min_history=5, max_history=0)
    assert whole.count() == sum(int(u[1:]) for u in per_user)


def test_metrics_fixture(spark):
    ranks = spark.createDataFrame([(1,), (3,), (None,), (7,)], "rank int")
    row = metrics.rank_metrics(ranks, [5, 10]).first()
    assert (row.n_evaluated, row.hit_at_5, row.hit_at_10, row.ndcg_at_5) == (4, 0.5, 0.75, 0.375)
    assert row.ndcg_at_10 == pytest.approx(0.458333, abs=1e-6)
    assert row.mrr_at_10 == pytest.approx(0.369048, abs=1e-6)
    wide = metrics.rank_metrics(ranks, list(range(1, 11))).first()
    assert [wide[f"hit_at_{k}"] for k in range(1, 11)] == sorted(wide[f"hit_at_{k}"] for k in range(1, 11))


def test_unknown_items_shift_ranks(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "zz", 2), ("q", "b", 3)], "query string, asin string, rank int")
    known = spark.createDataFrame([("a",), ("b",)], "asin string")
    asked = spark.createDataFrame([("q",), ("r",)], "query string")
    assert rows(metrics.drop_unknown_items(lists, known, "query", "asin"), "asin", "rank") == [("a", 1), ("b", 2)]
    assert dict(rows(metrics.skip_counts(lists, known, asked, "query", "asin"))) == {
        "queries": 2,
        "skipped_inference": 1,
        "skipped_unknown_item": 1,
    }


def test_target_ranks(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, asin string, rank int")
    targets = spark.createDataFrame([("q", "b"), ("r", "a")], "query string, asin string")
    assert rows(metrics.target_ranks(lists, targets, ["query", "asin"])) == [("q", "b", 2), ("r", "a", None)]


def test_latency_fixture(spark):
    row = quantiles.latency_summary(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "ms double"), "ms").first()
    assert (row.n, row.mean, row.min, row.max, row.median) == (4, 4.0, 1.0, 10.0, 2.5)
    assert (row.p95, row.p99) == (pytest.approx(8.95), pytest.approx(9.79))


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_percentiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(4)
    # A third of all values are one value, and a few are far away.
    data = np.concatenate([np.round(rng.exponential(20, 2000), 2), np.full(1000, 7.5), [1e6, -3.0]])
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double").repartition(6)
    row = quantiles.value_summary(df, "v", [0, 25, 50, 95, 99.9, 100], buckets).first()
    got = [row[f"p{p}"] for p in ("0", "25", "50", "95", "99_9", "100")]
    assert got == pytest.approx(list(np.percentile(data, [0, 25, 50, 95, 99.9, 100])))


def test_profile(spark):
    df = spark.createDataFrame(
        [("u", "a")] * 5 + [("v", "a"), ("v", "b"), (None, "c"), ("w", None)], "reviewerID string, asin string"
    )
    assert dict(rows(profile.dataset_profile(df))) == {
        "n_interactions": 7,
        "n_pairs": 3,
        "n_users": 2,
        "n_items": 2,
        "n_eligible_users": 1,
    }


def test_percentiles_of_little_data(spark):
    one = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert quantiles.latency_summary(one, "v").first().median == 4.0
    assert quantiles.latency_summary(one.where("v > 9"), "v").first().median is None
