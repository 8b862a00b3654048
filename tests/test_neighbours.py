import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmate.operators import knn, matrix
from shelfmate.plans import knn_recommender as kr

CELLS = [
    ("u1", "i1", 5.0),
    ("u1", "i2", 3.0),
    ("u2", "i1", 4.0),
    ("u2", "i3", 2.0),
    ("u3", "i2", 1.0),
    ("u3", "i2", 4.0),
    ("u4", "i4", 5.0),
]
SCHEMA = "reviewerID string, asin string, rating double"


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame(CELLS, SCHEMA).withColumn("product_title", F.concat(F.lit("T "), "asin"))
    cells = matrix.rating_matrix(df)
    return cells, kr.model_catalogue(cells, df)


def test_cells_are_summed(spark):
    df = spark.createDataFrame(CELLS, SCHEMA)
    assert ("u3", "i2", 5.0) in rows(matrix.rating_matrix(df))
    assert ("u3", "i2", 202.0) in rows(matrix.confidence_matrix(df))


def test_fixture_neighbours(spark, small):
    cells, catalogue = small
    seeds = spark.createDataFrame([("i1",), ("i4",), ("zz",), ("i1",)], "seed string")
    got = rows(kr.recommend_seeds(cells, catalogue, seeds, 10), "seed", "rank", "asin", "title", F.round("score", 6), "status")
    assert got == [
        ("i1", 1, "i3", "T i3", 0.624695, "ok"),
        ("i1", 2, "i2", "T i2", round(15 / math.sqrt(41 * 34), 6), "ok"),
        ("i4", None, None, None, None, "no_neighbours"),
        ("zz", None, None, None, None, "not_found"),
    ]


def test_fixture_history(spark, small):
    cells, catalogue = small
    histories = spark.createDataFrame(
        [("q", 1, "i1"), ("q", 2, "i2"), ("r", 1, "gone"), ("r", 2, "i3"), ("s", 1, "gone")],
        "query string, pos int, asin string",
    )
    got = rows(kr.recommend_histories(cells, catalogue, histories, 2), "query", "rank", "asin", "status")
    assert got == [("q", 1, "i3", "ok"), ("r", 1, "i1", "ok"), ("s", None, None, "not_found")]
    both = rows(kr.recommend_histories_by_score(cells, catalogue, histories, 2), "query", "rank", "asin")
    assert both == [("q", 1, "i3"), ("r", 1, "i1"), ("s", None, None)]


def test_tiny_similarities_stay(spark):
    """Two items that share one user among very many others: similarity far below 1e-9, still neighbours."""
    cells = spark.createDataFrame(
        [("u", "a", 1.0), ("u", "b", 1.0), ("v", "a", 60000.0), ("w", "b", 60000.0)], "reviewerID string, asin string, w double"
    )
    items = matrix.coded_items(cells)
    assert knn.cosine_neighbours(cells, items, 5).count() == 2
    assert knn.cosine_neighbours(cells, items, 5, seeds=items.select("item_idx", F.lit(1).alias("k"))).count() == 2


def test_bad_ratings_do_not_stop_training(spark, tmp_path):
    rows_ = [("u1", "a", "5"), ("u1", "b", "4.0"), ("u2", "a", "abc"), ("u2", "b", None), ("u3", "c", "NaN")]
    text = spark.createDataFrame(rows_, SCHEMA.replace("rating double", "rating string")).withColumn("product_title", F.lit("t"))
    assert kr.KnnRecommender.fit(text, str(tmp_path / "text")).neighbours(3).count() == 2
    number = spark.createDataFrame([("u1", "a", 5.0), ("u1", "b", 4.0), ("u2", "a", float("nan"))], SCHEMA)
    number = number.withColumn("product_title", F.lit("t"))
    assert kr.KnnRecommender.fit(number, str(tmp_path / "number")).neighbours(3).count() == 2

@pytest.mark.parametrize("top_k", [0, 101])
def test_top_k_bounds(spark, small, top_k):
    with pytest.raises(ValueError):
        kr.recommend_seeds(*small, spark.createDataFrame([("i1",)], "seed string"), top_k)


def random_cells(spark, hot_user=False, hot_item=False, users=60, items=90, seed=3):
    rng = np.random.default_rng(seed)
    cells = {(f"u{rng.integers(users)}", f"i{rng.integers(items)}"): float(rng.integers(1, 6)) for _ in range(700)}
    if hot_user:
        cells.update({("hot", f"i{i}"): float(1 + i % 5) for i in range(items)})
    if hot_item:
        cells.update({(f"u{u}", "i0"): float(1 + u % 5) for u in range(users)})
    return cells, spark.createDataFrame([(u, i, w) for (u, i), w in cells.items()], "reviewerID string, asin string, w double")


def brute_force(cells, codes, top_k):
    users = sorted({u for u, _ in cells})
    dense = np.zeros((len(codes), len(users)))
    for (u, i), w in cells.items():
        dense[codes[i], users.index(u)] = w
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    sims = np.round(dense @ dense.T, 9)
    np.fill_diagonal(sims, 0)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(row)) if row[j] > 0), key=lambda j: (-row[j], j))
        out[i] = [(j, row[j]) for j in order[:top_k]]
    return out


@pytest.mark.parametrize("hot_user, hot_item", [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize(
    "options",
    [{}, {"light": 0}, {"block_size": 16, "light": 0}, {"block_size": 16, "tile_cells": 40, "light": 0}, {"block_size": 16, "tile_cells": 40, "light": 9}],
)
def test_exact_for_any_blocking_and_skew(spark, monkeypatch, hot_user, hot_item, options):
    monkeypatch.setattr(knn, "CHUNK_BLOCKS", 2)
    cells, df = random_cells(spark, hot_user, hot_item)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    expected = brute_force(cells, codes, 5)
    for seeds in (None, items.select("item_idx", F.lit(5).alias("k"))):
        got = {}
        for r in knn.cosine_neighbours(df, items, 5, seeds=seeds, **options).collect():
            got.setdefault(r.item_idx, []).append((r["rank"], r.other_idx, r.score))
        assert set(got) == {i for i, best in expected.items() if best}
        for i, found in got.items():
            found.sort()
            assert [f[0] for f in found] == list(range(1, len(found) + 1))
            assert [f[1] for f in found] == [e[0] for e in expected[i]]
            assert [f[2] for f in found] == pytest.approx([e[1] for e in expected[i]], abs=2e-9)


@pytest.mark.parametrize("options", [{}, {"block_size": 16, "light": 0}, {"block_size": 16, "tile_cells": 40, "light": 9}])
@pytest.mark.parametrize("how", ["sum", "max"])
def test_scores_over_whole_histories(spark, how, options):
    """Candidates take every similarity to the history, also beyond the nearest few of an item."""
    cells, df = random_cells(spark, True, True)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    sims = {i: dict(best) for i, best in brute_force(cells, codes, len(codes)).items()}
    histories = {"short": ["i0", "i1"], "long": sorted(codes)[: len(codes) - 12]}
    catalogue = items.withColumn("title", F.lit("t"))
    asked = spark.createDataFrame([(q, n, i) for q, h in histories.items() for n, i in enumerate(h)], "query string, pos int, asin string")
    found = kr.recommend_histories_by_score(df, catalogue, asked, 10, how, **options).collect()
    for q, history in histories.items():
        seen = {codes[i] for i in history}
        scores = {j: [sims[i][j] for i in seen if j in sims[i]] for j in set(codes.values()) - seen}
        want = sorted(({"sum": sum, "max": max}[how](s) for s in scores.values() if s), reverse=True)[:10]
        got = sorted((r for r in found if r.query == q), key=lambda r: r["rank"])
        assert len(got) == len(want) == 10
        assert [r.score for r in got] == pytest.approx(want, abs=1e-6)
        assert [r.score for r in got] == pytest.approx([{"sum": sum, "max": max}[how](scores[r.item_idx]) for r in got], abs=1e-6)


@pytest.mark.parametrize("tied", [False, True])
def test_dense_tile_shortcut_equals_full_sort(monkeypatch, tied):
    rng = np.random.default_rng(9)
    tile = np.where(rng.random((64, 64)) < 0.9, rng.integers(1, 4, (64, 64)) / 7 if tied else rng.random((64, 64)), 0)
    k = np.full(64, 2)
    for by_column in (False, True):
        monkeypatch.setattr(knn, "DENSE_SHARE", 0.0)
        short = knn.best_of_tile(tile, k, by_column)
        monkeypatch.setattr(knn, "DENSE_SHARE", 2.0)
        full = knn.best_of_tile(tile, k, by_column)
        assert all((a == b).all() for a, b in zip(short, full))
        assert len(full[0]) == 64 * 2


def test_long_messages_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [(3, 4), (30, 20), (1, 1), (32, 32)]
    li = np.concatenate([rng.permutation(32)[:n] for n, _ in sizes])
    ri = np.concatenate([rng.permutation(32)[:n] for _, n in sizes])
    lo, ro = np.cumsum([0, *[n for n, _ in sizes]]), np.cumsum([0, *[n for _, n in sizes]])
    lx, rx = rng.random(len(li)), rng.random(len(ri))
    tiles = []
    for limit in (10, 10**6):
        monkeypatch.setattr(knn, "LONG_MESSAGE", limit)
        tiles.append(np.zeros((32, 32)))
        knn.add_products(tiles[-1], li, lx, lo, ri, rx, ro)
    assert np.allclose(*tiles)


def test_only_users_of_a_seed_send_messages(spark):
    df = spark.createDataFrame(
        [(f"u{u}", f"i{u // 10}", 1.0) for u in range(100)] + [("u0", "i7", 1.0)], "reviewerID string, asin string, w double"
    )
    items = matrix.coded_items(df)
    seed = items.where("asin = 'i7'").select("item_idx", F.lit(3).alias("k"))
    vectors = knn.normalized_cells(df, items, 64, seed)
    assert knn.block_messages(vectors, 64, knn.TILE_CELLS).count() == 11


def test_seeds_have_their_own_depth(spark):
    _, df = random_cells(spark)
    items = matrix.coded_items(df)
    seeds = spark.createDataFrame([(0, 1), (1, 7)], "item_idx int, k int")
    got = knn.cosine_neighbours(df, items, 1, seeds=seeds, block_size=16)
    assert rows(got.groupBy("item_idx").count()) == [(0, 1), (1, 7)]


def test_scores_are_symmetric(spark):
    _, df = random_cells(spark)
    items = matrix.coded_items(df)
    pairs = {(r.item_idx, r.other_idx): r.score for r in knn.cosine_neighbours(df, items, 100, block_size=32).collect()}
    assert all(pairs[(j, i)] == s for (i, j), s in pairs.items())


def test_a_busy_user_does_not_send_every_pair(spark):
    """A user with n items in B blocks sends B * (B + 1) / 2 messages."""
    df = spark.createDataFrame([("hot", f"i{i}", 1.0) for i in range(640)], "reviewerID string, asin string, w double")
    vectors = knn.normalized_cells(df, matrix.coded_items(df), 64)
    messages = knn.block_messages(vectors, 64, knn.TILE_CELLS)
    assert messages.count() == 10 * 11 // 2
    assert messages.agg(F.sum(F.size("li") + F.size("ri"))).first()[0] == 640 * 11


def test_history_answer_is_first_items_neighbours_without_history(spark):
    _, df = random_cells(spark)
    catalogue = matrix.coded_items(df).withColumn("title", F.lit(None).cast("string"))
    history = [r.asin for r in catalogue.orderBy("item_idx").limit(20).collect()]
    table = spark.createDataFrame([("q", p, a) for p, a in enumerate(history)], "query string, pos int, asin string")
    got = [r.asin for r in kr.recommend_histories(df, catalogue, table, 10).orderBy("rank").collect()]
    near = kr.recommend_seeds(df, catalogue, spark.createDataFrame([(history[0],)], "seed string"), 100)
    wanted = [r.asin for r in near.orderBy("rank").collect() if r.asin not in history][:10]
    assert got == wanted and len(got) == 10


def test_stored_model(spark, tmp_path):
    df = spark.createDataFrame(CELLS, SCHEMA).withColumn("product_title", F.lit(None).cast("string"))
    kr.KnnRecommender.fit(df, str(tmp_path))
    model = kr.KnnRecommender.load(spark, str(tmp_path))
    assert rows(model.health()) == [("n_cells", 6), ("n_items", 4), ("n_users", 4)]
    answer = model.recommend(spark.createDataFrame([("i3",)], "seed string"), 5).first()
    assert answer.title == "Unknown Product" and math.isclose(answer.score, 0.624695, abs_tol=1e-6)


def test_stored_graph_answers_like_the_matrix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kr, "ITEMS_PER_BUCKET", 7)
    _, df = random_cells(spark, hot_user=True)
    df = df.withColumnRenamed("w", "rating").withColumn("product_title", F.concat(F.lit("T "), "asin"))
    lonely = spark.createDataFrame([("only", "alone", 3.0, None)], "reviewerID string, asin string, rating double, product_title string")
    model = kr.KnnRecommender.fit(df.select(*lonely.columns).union(lonely), str(tmp_path), graph_depth=8)
    assert model.buckets > 10
    seeds = spark.createDataFrame([("i1",), ("i2",), ("i2",), ("alone",), ("gone",), (None,)], "seed string")
    names = ["seed", "seed_title", "rank", "asin", "title", "score", "status"]
    for top_k in (8, 3):
        direct = kr.recommend_seeds(model.cells, model.catalogue, seeds, top_k)
        assert rows(model.recommend(seeds, top_k), *names) == rows(direct, *names)
    assert model.recommend(seeds, 9).where("rank = 9").count() == 2  # deeper than the graph
    asked = seeds.where("seed = 'i1'")
    plan = model.lists(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket").replace("(bucket", "bucket")


def test_refresh_equals_rebuild(spark, tmp_path):
    _, df = random_cells(spark, users=200, items=150, seed=8)
    df = df.withColumnRenamed("w", "rating").withColumn("product_title", F.concat(F.lit("T "), "asin"))
    columns = ["reviewerID", "asin", "rating", "product_title"]
    new = spark.createDataFrame([("u1", "i3", 2.0, "A"), ("u1", "i3", 1.0, "B"), ("fresh", "i5", 4.0, "Z"), ("fresh", "unseen", 5.0, None)], ", ".join(["reviewerID string", "asin string", "rating double", "product_title string"]))
    old = kr.KnnRecommender.fit(df.select(*columns), str(tmp_path / "old"), graph_depth=5)
    refreshed = old.refresh(new, str(tmp_path / "new"))
    rebuilt = kr.KnnRecommender.fit(df.select(*columns).union(new), str(tmp_path / "all"), graph_depth=5)
    columns = ["asin", "rank", "other", "score"]
    assert rows(refreshed.graph, *columns) == rows(rebuilt.graph, *columns)
    assert rows(refreshed.catalogue, "asin", "item_idx", "title") == rows(rebuilt.catalogue, "asin", "item_idx", "title")
    stale = spark.read.parquet(str(tmp_path / "new" / "refreshed")).count()
    assert 0 < stale < refreshed.catalogue.count() / 2


@pytest.mark.parametrize("hot_cells", [None, 12])
def test_light_users_send_rows_not_pairs(spark, monkeypatch, hot_cells):
    """Where all users are light no pair is shuffled, unless its item is hot; the parts' number does not matter."""
    monkeypatch.setattr(knn, "PART_PRODUCTS", 500)
    if hot_cells:
        monkeypatch.setattr(knn, "HOT_CELLS", hot_cells)
    cells, df = random_cells(spark, False, True)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    expected = brute_force(cells, codes, 5)
    every = {(i, j): s for i, best in brute_force(cells, codes, len(codes)).items() for j, s in best}
    for seeds in (None, items.select("item_idx", (F.col("item_idx") % 3 + 1).alias("k")).where("item_idx % 2 = 0")):
        found = knn.cosine_neighbours(df, items, 5, seeds=seeds)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert (hot_cells is not None) == any("Aggregate [item_idx" in line and "other_idx" in line for line in plan.splitlines())
        got = {(r.item_idx, r["rank"]): (r.other_idx, r.score) for r in found.collect()}
        wanted = {i: best[: 5 if seeds is None else i % 3 + 1] for i, best in expected.items() if seeds is None or i % 2 == 0}
        assert {k: v[0] for k, v in got.items()} == {(i, n): j for i, best in wanted.items() for n, (j, _) in enumerate(best, 1)}
        similar = knn.cosine_similarities(df, items, items.select("item_idx") if seeds is None else seeds)
        scores = {(r.item_idx, r.other_idx): r.score for r in similar.collect()}
        assert scores == pytest.approx({p: s for p, s in every.items() if seeds is None or p[0] % 2 == 0}, abs=2e-9)


def test_light_users_rows_are_read_and_not_sent_to_parts(spark, monkeypatch):
    """Parts read the users' written rows: neither cells nor pairs are shuffled for them."""
    monkeypatch.setattr(knn, "PART_PRODUCTS", 5_000)
    monkeypatch.setattr(knn, "PRODUCTS_PER_STEP", 300)
    monkeypatch.setattr(knn, "PACKED_CELLS", 50)
    cells, df = random_cells(spark)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    found = knn.cosine_neighbours(df, items, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Range (0, " in plan
    got = {(r.item_idx, r["rank"]): (r.other_idx, r.score) for r in found.collect()}
    assert got == {(i, n): (j, pytest.approx(s, abs=2e-9)) for i, best in brute_force(cells, codes, 5).items() for n, (j, s) in enumerate(best, 1)}


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("products", [300, 10**7])
def test_histories_are_scored_without_shuffled_similarities(spark, monkeypatch, how, products):
    """A history with more products than a task takes at a time takes its items in groups."""
    monkeypatch.setattr(knn, "PART_PRODUCTS", products)
    monkeypatch.setattr(knn, "PRODUCTS_PER_STEP", 500)
    cells, df = random_cells(spark, seed=5)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    sims = {i: dict(best) for i, best in brute_force(cells, codes, len(codes)).items()}
    names = sorted(codes)
    histories = {"one": names[:1], "few": names[3:7], "many": names[: len(names) - 15], None: names[:2], "gone": ["nothing"]}
    asked = spark.createDataFrame([(q, n, i) for q, h in histories.items() for n, i in enumerate(h)], "query string, pos int, asin string")
    answers = kr.recommend_histories_by_score(df, items.withColumn("title", F.lit("t")), asked, 10, how)
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert "other_idx" not in plan
    found = [r for r in answers.collect() if r.status == "ok"]
    for q in ("one", "few", "many"):
        seen = {codes[i] for i in histories[q]}
        scores = {j: [sims[i][j] for i in seen if j in sims[i]] for j in set(codes.values()) - seen}
        scores = {j: round({"sum": sum, "max": max}[how](s), 9) for j, s in scores.items() if s}
        want = sorted(scores, key=lambda j: (-scores[j], j))[:10]
        got = sorted((r["rank"], r.item_idx, r.score) for r in found if r.query == q)
        assert [g[0] for g in got] == list(range(1, len(want) + 1))
        assert [g[2] for g in got] == pytest.approx([scores[j] for j in want], abs=1e-7)


def test_similarities_within_wanted_labels(spark):
    cells, df = random_cells(spark, seed=6)
    items = matrix.coded_items(df)
    codes = {r.asin: r.item_idx for r in items.collect()}
    every = brute_force(cells, codes, len(codes))
    label = {i: None if i % 11 == 0 else i % 4 for i in codes.values()}
    want = {i: None if i % 7 == 0 else (i + 1) % 4 for i in codes.values()}
    labels = spark.createDataFrame([(i, label[i], want[i]) for i in label], "item_idx int, label long, want long")
    got = {}
    for r in knn.cosine_similarities(df, items, items.select("item_idx"), labels=labels, depth=3).collect():
        got.setdefault(r.item_idx, {})[r.other_idx] = r.score
    for i, best in every.items():
        same = [(j, s) for j, s in best if want[i] is not None and label[j] == want[i]][:3]
        assert got.get(i, {}) == {j: pytest.approx(s, abs=2e-9) for j, s in same}
