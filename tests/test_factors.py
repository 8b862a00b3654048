import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmate.operators import als, factors
from shelfmate.plans import als_recommender
from shelfmate.plans.als_recommender import AlsParams, AlsRecommender, equation_residuals, fit_factors


def vectors(spark, n, f, key, seed):
    data = np.random.default_rng(seed).normal(size=(n, f))
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], f"{key} int, vector array<double>")
    return data, frame


@pytest.mark.parametrize("block_size", [4096, 7])
def test_top_items_with_exclusions(spark, block_size):
    q, queries = vectors(spark, 23, 5, "query", 1)
    y, items = vectors(spark, 40, 5, "item_idx", 2)
    # Query 0 has seen everything, query 1 all but one item.
    seen = {(0, i) for i in range(40)} | {(1, i) for i in range(39)} | {(a, (a * 7) % 40) for a in range(2, 23)}
    banned = spark.createDataFrame(sorted(seen) + [(2, 999), (77, 1)], "query int, item_idx int")
    got = {}
    for r in factors.top_items(queries, items, 6, exclude=banned, block_size=block_size).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.item_idx
    scores = np.round(q @ y.T, 9)
    for a in range(23):
        order = [i for i in sorted(range(40), key=lambda i: (-scores[a, i], i)) if (a, i) not in seen][:6]
        assert [got.get(a, {}).get(k + 1) for k in range(len(order))] == order
    assert 0 not in got and got[1] == {1: 39}


@pytest.mark.parametrize("kind", ["lengths", "clusters", "unit", "zeros"])
def test_bounds_leave_out_tiles_but_no_answer(spark, kind):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(600, 6))
    if kind == "lengths":
        y *= rng.pareto(1.0, size=(600, 1)) + 0.01
    elif kind == "clusters":
        y = rng.normal(size=(8, 6))[rng.integers(8, size=600)] + 0.02 * y
    elif kind == "unit":
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    else:
        y[::2] = 0.0
    q = rng.normal(size=(50, 6))
    q[0] = 0.0
    # Query 1 has seen its 500 best items, query 2 everything.
    seen = [(1, int(i)) for i in np.argsort(-(y @ q[1]))[:500]] + [(2, i) for i in range(600)]
    as_rows = lambda m: [(i, [float(x) for x in row]) for i, row in enumerate(m)]
    queries = spark.createDataFrame(as_rows(q), "query int, vector array<double>")
    items = spark.createDataFrame(as_rows(y), "item_idx int, vector array<double>")
    report = {}
    answers = factors.top_items(queries, items, 5, spark.createDataFrame(seen, "query int, item_idx int"), block_size=16, report=report)
    got = {}
    for r in answers.collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.item_idx, r.score)
    scores, banned = np.round(q @ y.T, 9), set(seen)
    for a in range(50):
        order = [i for i in sorted(range(600), key=lambda i: (-scores[a, i], i)) if (a, i) not in banned][:5]
        assert [s for _, s in sorted(got.get(a, {}).values(), key=lambda v: -v[1])] == pytest.approx([scores[a, i] for i in order], abs=2e-9)
        if kind not in ("zeros",) and a:
            assert [got[a][k + 1][0] for k in range(len(order))] == order
    assert 0 < report["visited"] <= report["all"]
    if kind in ("lengths", "clusters"):
        assert report["visited"] < 0.6 * report["all"]


def test_visits_on_the_embeddings_table(spark):
    """Items of different lengths: part of the tiles answers every query."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    items = table.select(F.col("vec_id").alias("item_idx"), F.transform("embedding", lambda x: x * F.pow(F.lit(1.5), F.col("label"))).alias("vector"))
    queries = table.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    report = {}
    assert factors.top_items(queries, items, 10, block_size=32, report=report).count() == 10 * queries.count()
    assert 0 < report["visited"] < 0.8 * report["all"]


def test_similar_items_leave_out_the_seed(spark):
    y, items = vectors(spark, 30, 4, "item_idx", 5)
    seeds = spark.createDataFrame([(3,), (3,), (29,)], "item_idx int")
    got = factors.similar_items(items, 5, seeds)
    assert rows(got.groupBy("query").count()) == [(3, 5), (29, 5)] or rows(got.groupBy("query").count()) == [(29, 5), (3, 5)]
    assert got.where("query = item_idx").count() == 0
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit[3]))[1]
    assert got.where("query = 3 and rank = 1").first().item_idx == best


def test_gram_matrix(spark):
    y, items = vectors(spark, 50, 4, "item_idx", 6)
    assert np.allclose(factors.gram_array(items.repartition(5)), y.T @ y)


def test_fold_in_is_linear_and_counts_repeats(spark):
    y, items = vectors(spark, 12, 3, "item_idx", 7)
    histories = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 2), ("c", 99), ("d", 99)], "query string, item_idx int")
    got = {r["query"]: np.array(r.vector) for r in factors.fold_in(histories, items, 0.1).collect()}
    inverse = np.linalg.inv(y.T @ y + 0.1 * np.eye(3))
    assert set(got) == {"a", "b", "c"}
    assert np.allclose(got["a"], inverse @ y[1])
    assert np.allclose(got["b"], 2 * got["a"])
    assert np.allclose(got["c"], inverse @ y[2])


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    found = {(int(rng.integers(30)), int(rng.integers(40))): 1 + 40.0 * int(rng.integers(4, 6)) for _ in range(250)}
    return spark.createDataFrame([(u, i, c) for (u, i), c in found.items()], "user_idx int, item_idx int, c double")


def test_user_vectors_solve_their_equation(spark, cells):
    params = AlsParams(factors=4, iterations=3)
    users, items = fit_factors(cells, params)
    worst = equation_residuals(cells, users, items, params.regularization).agg(F.max("residual")).first()[0]
    assert worst < 1e-4
    again, _ = fit_factors(cells, params)
    assert rows(users, "user_idx", "vector") == rows(again, "user_idx", "vector")


def test_als_blocks_follow_the_cells_and_not_the_cores(spark, cells, monkeypatch):
    seen = []
    real = als_recommender.ALS
    monkeypatch.setattr(als_recommender, "ALS", lambda **given: seen.append(given) or real(**given))
    for per_block, blocks in ((1_000_000, 5), (20, -(-cells.count() // 20))):
        monkeypatch.setattr(als_recommender, "CELLS_PER_BLOCK", per_block)
        users, _ = fit_factors(cells, AlsParams(factors=2, iterations=1))
        assert users.count() == cells.select("user_idx").distinct().count()
        assert seen[-1]["numUserBlocks"] == seen[-1]["numItemBlocks"] == blocks


def test_plain_ridge_equals_plain_loops_with_hot_rows_split(spark):
    rng = np.random.default_rng(17)
    found = {(int(rng.integers(30)), int(rng.integers(40))): 1 + 40.0 * int(rng.integers(4, 6)) for _ in range(250)}
    found |= {(99, i): 1 + 40.0 * (4 + i % 2) for i in range(120)}  # a third of the cells
    cells = spark.createDataFrame([(u, i, c) for (u, i), c in found.items()], "user_idx int, item_idx int, c double")
    users, items = als.fit_plain(cells, 4, 2, 0.05, chunk=25)
    assert als.deal(cells, "user_idx", "item_idx", 25).where("key = 99").agg(F.max("parts"), F.countDistinct("part")).first() == (5, 5)
    got_users = {r.user_idx: np.array(r.vector) for r in users.collect()}
    got_items = {r.item_idx: np.array(r.vector) for r in items.collect()}
    first = als.first_vectors(cells.select(F.col("item_idx").alias("idx")).distinct(), 4, 42)
    y = {r.idx: np.array(r.vector) for r in first.collect()}

    def step(fixed, side):
        gram = sum(np.outer(v, v) for v in fixed.values())
        out = {}
        for key in {k[side] for k in found}:
            mine = [(fixed[k[1 - side]], c) for k, c in found.items() if k[side] == key]
            left = gram + sum((c - 1) * np.outer(v, v) for v, c in mine) + 0.05 * np.eye(4)
            out[key] = np.linalg.solve(left, sum(c * v for v, c in mine))
        return out

    for _ in range(2):
        x = step(y, 0)
        y = step(x, 1)
    assert set(got_users) == set(x) and set(got_items) == set(y)
    assert all(np.allclose(got_users[k], x[k], rtol=1e-6, atol=1e-9) for k in x)
    assert all(np.allclose(got_items[k], y[k], rtol=1e-6, atol=1e-9) for k in y)
    # Each side against the vectors it was solved for.
    swapped = cells.select(F.col("item_idx").alias("user_idx"), F.col("user_idx").alias("item_idx"), "c")
    last = equation_residuals(swapped, items.withColumnRenamed("item_idx", "user_idx"), users.withColumnRenamed("user_idx", "item_idx"), 0.05, plain=True)
    again = als.half_step(als.deal(cells, "user_idx", "item_idx", 25), items.withColumnRenamed("item_idx", "idx"), 0.05).withColumnRenamed("idx", "user_idx")
    for checked in (last, equation_residuals(cells, again, items, 0.05, plain=True)):
        assert checked.agg(F.max("residual")).first()[0] < 1e-6


@pytest.mark.parametrize("chunk", [25, 20_000])
def test_residuals_by_hand_and_a_vector_travels_once_per_cell(spark, chunk):
    rng = np.random.default_rng(23)
    found = {(u, int(i)): 1.0 + 40 * int(rng.integers(1, 6)) for u in range(12) for i in rng.choice(130, 5, replace=False)}
    found |= {(99, i): 1 + 40.0 * (4 + i % 2) for i in range(120)} | {(7, 500): 41.0, (8, 501): 41.0, (50, 500): 41.0}
    x = {u: rng.normal(size=3) for u in [*range(11), 50, 60, 99]}  # 11 has no vector, 50 only a cell of an unknown item
    y = {i: rng.normal(size=3) for i in range(130)}
    cells = spark.createDataFrame([(u, i, c) for (u, i), c in found.items()], "user_idx int, item_idx int, c double")
    users = spark.createDataFrame([(u, v.tolist()) for u, v in x.items()], "user_idx int, vector array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in y.items()], "item_idx int, vector array<double>")
    gram = sum(np.outer(v, v) for v in y.values())
    for scaled in (True, False):
        got = {r.user_idx: (r.n_cells, r.residual) for r in als.residuals(cells, users, items, 0.05, scaled, chunk).collect()}
        assert set(got) == {*range(11), 99}
        for u, (n, residual) in got.items():
            mine = [(y[i], c) for (v, i), c in found.items() if v == u and i in y]
            assert n == sum(v == u for v, _ in found)
            left = gram @ x[u] + sum((c - 1) * v * (v @ x[u]) for v, c in mine) + 0.05 * (n if scaled else 1) * x[u]
            right = sum(c * v for v, c in mine)
            assert np.isclose(residual, np.abs(left - right).max() / np.abs(right).max())
    plan = equation_residuals(cells, users, items, 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "item_idx" not in plan  # no join of both vectors to every cell is left to run


def test_alpha_must_be_positive(spark, cells):
    with pytest.raises(ValueError):
        fit_factors(cells, AlsParams(alpha=0.0))


def test_stored_als_model(spark, tmp_path):
    rng = np.random.default_rng(13)
    data = [(f"u{rng.integers(20)}", f"i{rng.integers(25)}", str(rng.integers(3, 6)), "T") for _ in range(300)]
    data.append(("u1", "i1", "bad", "T"))
    df = spark.createDataFrame(data, "reviewerID string, asin string, rating string, product_title string")
    AlsRecommender.fit(df, str(tmp_path), AlsParams(factors=3, iterations=2))
    model = AlsRecommender.load(spark, str(tmp_path))
    assert model.params.factors == 3
    report = spark.read.json(f"{tmp_path}/report").first()
    assert report.n_rows == df.where("rating >= '4' and rating <> 'bad'").count() and report.total_s > report.train_s > 0
    vectors = np.array([r.vector for r in model.tables["item_factors"].collect()], dtype=float)
    assert np.allclose(model.factor @ model.factor.T, vectors.T @ vectors + model.params.regularization * np.eye(3))
    seen = model.tables["cells"].select(F.col("user_idx").alias("query"), "item_idx")
    answers = model.recommend_users(model.tables["users"], 5)
    assert answers.count() > 0
    assert answers.join(seen, ["query", "item_idx"], "left_semi").count() == 0
    every = model.recommend_users(model.tables["users"], 5, exclude_seen=False)
    assert every.count() == 5 * model.tables["users"].count()

    histories = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("z", 999)], "query string, item_idx int")
    with pytest.MonkeyPatch.context() as patch:  # the stored factor is enough: no pass over the items for a Gram matrix
        patch.setattr(factors, "gram_array", lambda *a: pytest.fail("Gram matrix made anew"))
        folded = model.recommend_histories(histories, 4)
    assert rows(folded.groupBy("query").count()) == [("x", 4), ("y", 4)]
    assert folded.join(histories, ["query", "item_idx"], "left_semi").count() == 0

    near = model.similar(spark.createDataFrame([("i1",), ("nope",)], "seed string"), 3)
    assert rows(near.groupBy("seed", "status").count()) == [("i1", "ok", 3), ("nope", "not_found", 1)]
    assert near.where("seed = asin").count() == 0


def test_vectors_travel_once_per_bundle(spark, monkeypatch):
    """Queries go to bundles of tiles, not to each tile; the answers do not depend on the bundles."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 4)) * 1.5 ** rng.integers(0, 9, size=(300, 1))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_idx int, vector array<double>")
    groups, placed = factors.group_items(items, 16)
    bundles = groups.bundles(16)
    assert len(bundles) == groups.tiles.sum() > 2 * len(set(bundles.tolist()))
    assert placed.count() == 300 and (np.diff(bundles) >= 0).all()
    scores = np.round(vectors[:40] @ vectors.T, factors.SCORE_DIGITS)
    np.fill_diagonal(scores, -np.inf)
    expected = {q: np.lexsort((np.arange(300), -row))[:5].tolist() for q, row in enumerate(scores)}
    queries = items.where("item_idx < 40").withColumnRenamed("item_idx", "query")
    itself = queries.select("query", queries["query"].alias("item_idx"))
    for size in (16, 100):
        monkeypatch.setattr(factors, "BUNDLE", size)
        got = {}
        for r in factors.top_items(queries, items, 5, exclude=itself, block_size=16).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.item_idx)
        assert got == expected


@pytest.mark.parametrize("n_factors", [3, 24])
def test_many_cells_train_without_shuffled_vectors(spark, cells, monkeypatch, n_factors):
    """Beyond MOST_SHUFFLED_CELLS the same equations are solved by half-steps that read written vectors; hot rows go in parts."""
    monkeypatch.setattr(als_recommender, "MOST_SHUFFLED_CELLS", 100)
    monkeypatch.setattr(als_recommender, "ALS", lambda **given: pytest.fail("vectors would be shuffled once per block"))
    hot = spark.createDataFrame([(99, i, 1 + 40.0 * (4 + i % 2)) for i in range(40)], "user_idx int, item_idx int, c double")
    params = AlsParams(factors=n_factors, iterations=3)
    users, items = fit_factors(cells.union(hot), params)
    assert users.schema["vector"].dataType.simpleString() == "array<float>"
    assert "Exchange" not in users._jdf.queryExecution().executedPlan().toString()
    checked = equation_residuals(cells.union(hot), users, items, params.regularization)
    assert checked.count() == users.count() == cells.select("user_idx").distinct().count() + 1
    assert checked.agg(F.max("residual")).first()[0] < 1e-4
    split_users, split_items = als.fit_plain(cells.union(hot), n_factors, 3, params.regularization, chunk=12, scaled=True)
    assert equation_residuals(cells.union(hot), split_users, split_items, params.regularization).agg(F.max("residual")).first()[0] < 1e-6
    whole = {r.user_idx: r.vector for r in users.collect()}
    assert all(np.allclose(r.vector, whole[r.user_idx], rtol=1e-2, atol=1e-3) for r in split_users.collect())


def test_items_and_queries_meet_without_a_join(spark, monkeypatch):
    """Every block of queries reads the written tiles; an item's vector is neither shuffled nor joined."""
    monkeypatch.setattr(factors, "QUERY_BLOCK", 7)
    q, queries = vectors(spark, 23, 5, "query", 1)
    y, items = vectors(spark, 300, 5, "item_idx", 2)
    seen = spark.createDataFrame([(a, i) for a in range(23) for i in range(a, 300, 31)], "query int, item_idx int")
    found = factors.top_items(queries, items, 4, exclude=seen, block_size=16)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    scores = np.round(q @ y.T, 9)
    for a in range(23):
        scores[a, a::31] = -np.inf
    got = {(r["query"], r["rank"]): (r.item_idx, r.score) for r in found.collect()}
    for a in range(23):
        for rank, i in enumerate(np.lexsort((np.arange(300), -scores[a]))[:4], 1):
            assert got[a, rank] == (i, pytest.approx(scores[a, i], abs=2e-9))


@pytest.mark.parametrize("scale", [1e-30, 1e30])
def test_very_small_and_large_vectors_keep_their_order(spark, scale):
    q, queries = vectors(spark, 9, 4, "query", 3)
    y, items = vectors(spark, 80, 4, "item_idx", 4)
    big = items.withColumn("vector", F.transform("vector", lambda v: v * F.lit(scale)))
    turned = queries.withColumn("vector", F.transform("vector", lambda v: v * F.lit(1 / scale)))
    got = {}
    for r in factors.top_items(turned, big, 6, block_size=16).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.item_idx)
    assert got == {a: np.argsort(-(y @ q[a]))[:6].tolist() for a in range(9)}


def test_sums_of_items_shuffle_no_vector(spark, monkeypatch):
    monkeypatch.setattr(factors, "SUMMED_BYTES", 100)
    y, items = vectors(spark, 40, 3, "item_idx", 9)
    history = [(f"q{a}", (a * 7 + b) % 45) for a in range(12) for b in range(a)] + [("q3", 21), ("only", 99), (None, 3), ("q1", None)]
    histories = spark.createDataFrame(history, "query string, item_idx int").repartition(2)
    found = factors.sum_of_items(histories, items.union(items.where("item_idx = 5")))  # the vector of 5 is there twice
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["query"]: r.vector for r in found.collect()}
    y[5] *= 2
    for name in {h[0] for h in history}:
        mine = [i for n, i in history if n == name and i is not None and i < 40]
        assert (name in got) == bool(mine) and (not mine or np.allclose(got[name], y[mine].sum(axis=0)))
