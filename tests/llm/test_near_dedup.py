import math
from collections import Counter

import numpy as np
import pytest

from shelfmate.llm import near_dedup
from shelfmate.llm.components import components

from .helpers import awkward, classes_by_hand, documents, nothing


def by_hand(docs, similarity=0.8):
    """All pairs: classes of doc ids."""
    split = {k: (t or "").encode().split() for k, t in docs}
    df = Counter(w for words in split.values() for w in set(words))
    idf = lambda w: 1 + math.log(1 / max(df[w] / len(docs), near_dedup.RARE))
    weights = {}
    for k, words in split.items():
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        weights[k] = {g: n * sum(map(idf, g)) / len(g) for g, n in Counter(grams).items()}
    links, keys = [], sorted(weights)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = sum(min(weights[a][g], weights[b][g]) for g in weights[a].keys() & weights[b].keys())
            if shared and shared / (sum(weights[a].values()) + sum(weights[b].values()) - shared) >= similarity:
                links.append((a, b))
    return classes_by_hand(links, keys)


def check(spark, rows, **options):
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.class_id, set()).add(r.doc_id)
    assert mine == by_hand(rows)
    assert Counter(r.class_id for r in got if r.kept) == Counter(dict.fromkeys(mine, 1))
    assert all(r.class_size == len(mine[r.class_id]) for r in got)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in documents(spark).collect()])


def test_group_of_edited_copies_and_common_passage(spark):
    """Copies with few to many edits, so that many pairs are just above or below the threshold, among
    documents that share a long passage without being near copies."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base, passage = list(draw.choice(words, 150)), list(draw.choice(words, 40))
    rows = []
    for i in range(120):
        copy = base.copy()
        for place in draw.choice(150, draw.integers(0, 9), replace=False):
            copy[place] = str(draw.choice(words))
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join([*draw.choice(words, 30), *passage, *draw.choice(words, 20)])) for i in range(80)]
    check(spark, rows)


@pytest.mark.parametrize("rounds", [0, 3])
def test_family_about_the_threshold_in_small_tiles(spark, rounds):
    """Copies edited so much that few pairs are links, in tiles of four: hubs and tiles of several blocks against all pairs."""
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    base = list(draw.choice(words, 150))
    rows = []
    for i in range(60):
        copy = base.copy()
        for place in draw.choice(150, draw.integers(2, 6), replace=False):
            copy[place] = str(draw.choice(words))
        rows.append((i, " ".join(copy)))
    check(spark, rows, block=4, hubs_a_round=3, hub_rounds=rounds)


def star(n, edits=6, seed=5):
    """Copies of one text, each with words of its own in a few places: near none of the others."""
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in draw.choice(500, 150)]
    rows = []
    for i in range(n):
        copy = base.copy()
        for place in draw.choice(150, edits, replace=False):
            copy[place] = f"own{i}x{place}"
        rows.append((i, " ".join(copy)))
    return rows


def test_large_group_below_the_threshold_is_not_compared_with_itself(spark, monkeypatch):
    """Rows into the last tiles grow with the group, not with its square."""
    links, seen = near_dedup._links, []

    def counted(members, *rest):
        seen.append(members.count())
        return links(members, *rest)

    monkeypatch.setattr(near_dedup, "_links", counted)
    made = []
    for n in (100, 200):
        rows = star(n) + [(1000 + i, f"{t} end") for i, t in star(3)]
        got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: i % 1000 for i, _ in rows}
        made.append(seen[-1])
    assert made[1] <= 3 * made[0] + 50 and made[1] < 2000


@pytest.mark.parametrize("kind", ["replaced", "cut", "added"])
def test_prefixes_lose_no_similar_pair(kind):
    """Of similar texts that are not both linked to the hub, one asks with a feature the other is found by."""
    draw = np.random.default_rng(2)
    weight = draw.uniform(1, 8, 4000)
    hub = np.arange(100)
    texts = []
    for _ in range(12):  # kinds of copies, more or less like the hub, and copies of each
        lost, more = draw.random(100) < draw.uniform(0, 0.3), 100 + draw.choice(60, draw.integers(0, 25), replace=False)
        for _ in range(10):
            gone = np.zeros(100, bool) if kind == "added" else lost ^ (draw.random(100) < 0.03)
            new = [] if kind == "cut" else more[draw.random(len(more)) > 0.1]
            texts.append(np.sort(np.concatenate([hub[~gone], new])).astype(int))
    total = lambda of: weight[of].sum()
    similar = lambda a, b: total(np.intersect1d(a, b)) / total(np.union1d(a, b)) >= 0.8
    made = [near_dedup.prefixes(t.astype(np.uint64), weight[t], hub.astype(np.uint64), weight[hub], 0.8) for t in texts]
    asks, told = [set(f[:n]) for f, n, _ in made], [set(f[:n]) for f, _, n in made]
    pairs = 0
    for i, a in enumerate(texts):
        assert (made[i][1] == 0) == similar(a, hub)
        for j, b in enumerate(texts):
            if i != j and not similar(a, hub) and not np.array_equal(b, hub) and similar(a, b):
                assert asks[i] & told[j]
                pairs += 1
    assert pairs > 20


def test_links_between_components(spark):
    """More links join whole components, nodes that had no link before among them."""
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("m", "m"), ("n", "m")], "node string, root string")
    links = spark.createDataFrame([("d", "x"), ("b", "x"), ("y", "z")], "a string, b string")
    got = {r.node: r.root for r in near_dedup._joined(roots, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "a", "m": "m", "n": "m", "y": "y", "z": "y"}


def test_awkward(spark):
    docs = awkward(spark)
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[1].class_id == of[2].class_id == of[3].class_id == 1 and of[7].class_id == of[8].class_id == 7
    assert of[9].class_id == of[10].class_id == 9
    assert of[4].class_id == 4 and of[5].class_id == 5 and of[6].class_id == 6 and of[4].kept
    assert sum(r.kept for r in got if r.class_id == 1) == 1
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)
    assert near_dedup.near_classes(nothing(spark)).count() == 0


def test_sampling_agrees_with_similarity():
    """The share of equal samples estimates the weighted Jaccard similarity."""
    draw = np.random.default_rng(1)
    code = draw.integers(1, 2**63, 300).astype(np.uint64)
    sampler = near_dedup.Sampler(bands=400, rows=2)
    a = draw.uniform(1, 8, 300).astype(np.float32)
    b = np.where(draw.random(300) < 0.5, a, draw.uniform(1, 8, 300)).astype(np.float32)
    start = np.array([0])
    same = (sampler.smallest(code, np.log(a), start) == sampler.smallest(code, np.log(b), start)).mean()
    assert same == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.06)


def test_components(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x1", "x2"), ("x2", "x3"), ("x9", "x1")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"}
    assert {got[x] for x in ("x1", "x2", "x3", "x9")} == {"x1"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
