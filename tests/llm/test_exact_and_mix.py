import hashlib
import re
from collections import Counter, defaultdict

import pytest

from shelfmate.llm import exact_dedup, mixing

from .helpers import awkward, documents, nothing


def key_order(k):
    return (k is None, k if k is not None else 0)


def test_exact_groups_by_hand(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = defaultdict(list)
    for key, text in rows:
        groups[norm(text)].append((-len(text or ""), key_order(key), key))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for key, text in rows:
        members = groups[norm(text)]
        want[key, min(members)[2], len(members), hashlib.sha256(norm(text).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_hot_text(spark):
    """One text owns most rows, so its digest is hot and salted."""
    rows = [(i, "same text" if i % 4 else f"own text {i}") for i in range(4000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 4} == {(1, 3000)}
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 4 == 0)
    assert sum(r.kept for r in got) == 1001


def test_exact_drop_keeps_columns_and_one_row(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(nothing(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(nothing(spark)).count() == 0


def targets_by_hand(sizes):
    """The rule as it is stated: share by weight, cap, hand the excess on."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest, open_ = 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_mix_meets_targets(spark, block_rows):
    docs = documents(spark)
    got = mixing.mix(docs, block_rows=block_rows).collect()
    again = mixing.mix(docs.repartition(5), block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    sizes = Counter()
    for key, n in words.items():
        sizes[source[key]] += n
    want = targets_by_hand(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s], largest[s] / 2) for s in want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_expected_copies(spark):
    """Over many seeds a document is taken as often as its source's rate says."""
    import numpy as np

    sizes, share, hits = np.array([3.0, 5, 8, 13, 2, 7]), 0.37, np.zeros(6)
    for seed in range(4000):
        shares = np.full(6, share)
        draws = np.random.default_rng(seed).random(7)
        held = mixing.pivot(sizes, shares, draws)
        if held >= 0:
            shares[held] = float(draws[-1] < shares[held])
        assert set(shares) <= {0.0, 1.0}
        hits += shares
    assert np.abs(hits / 4000 - share).max() < 0.03


def test_large_documents_are_settled_first():
    """Words and expectations stay; a document that dominates its source goes where the target can be met."""
    import numpy as np

    sizes, hits, total = np.array([180.0, 150, *[40] * 30]), np.zeros(32), 0.37 * 1530
    for seed in range(3000):
        shares = np.full(32, 0.37)
        mixing.settle_large(sizes, shares, np.random.default_rng(seed).random(32))
        assert set(shares[:2]) <= {0.0, 1.0} and (sizes * shares).sum() == pytest.approx(total)
        hits += shares
    assert np.abs(hits / 3000 - 0.37).max() < 0.03
    shares = np.array([0.65, *[0.65] * 10])
    mixing.settle_large(np.array([1300.0, *[100] * 10]), shares, np.full(11, 0.99))
    assert shares[0] == 1 and (shares * [1300.0, *[100] * 10]).sum() == pytest.approx(0.65 * 2300)


def test_mix_spreads_repeated_keys(spark):
    """100,000 rows without a doc_id and of one size: no block beyond block_rows by much, and the target is met."""
    from pyspark.sql import functions as F

    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    own = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.lit("b").alias("source"))
    numbered = mixing.number_repeats(hot.select(F.col("doc_id").alias("_doc"), "source", F.lit(3).cast("long").alias("size")))
    assert numbered.agg(F.count("*"), F.count_distinct("_repeat"), F.max("_repeat")).first()[:] == (100_000, 100_000, 99_999)
    blocks = 100
    dealt = numbered.groupBy(F.pmod(F.xxhash64(F.lit(17), "_doc", "size", "_repeat"), F.lit(blocks)).alias("b")).count()
    assert dealt.agg(F.max("count")).first()[0] < 1_200
    got = mixing.mix(hot.unionAll(own), block_rows=1_000)
    assert got.count() == 105_000
    for row in got.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(row.taken - row.target) <= 3


def test_mix_awkward(spark):
    docs = awkward(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count()
    assert all(r.taken == 0 for r in got.where("size = 0").collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == got.groupBy().sum("copies").first()[0]
    assert mixing.mix(nothing(spark)).count() == 0
    assert mixing.mixed_documents(nothing(spark)).count() == 0


def test_only_hot_texts_meet_twice(spark):
    """Texts that own few rows are grouped whole once; the second grouping by text reads hot digests alone."""
    rows = [(i, "hot text" if i % 2 else f"text {i // 4}") for i in range(40)]
    groups = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = groups._jdf.queryExecution().optimizedPlan().toString().splitlines()
    second = next(n for n, line in enumerate(plan) if "Aggregate [_sha" in line and "_body" in line and "_salt" not in line)
    # A filter on hot turns the outer join with the hot digests into an inner one.
    assert "Join Inner" in next(line for line in plan[second + 1 :] if "Join" in line)
    sizes = {r.doc_id: (r.keep_id, r.group_size) for r in groups.collect()}
    assert sizes[1] == (1, 20) and sizes[2] == (0, 2) and len(sizes) == 40
