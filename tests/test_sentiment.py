import math

from conftest import rows

from shelfmate.operators import sentiment

TEXTS = [(1, "Good good, nice!"), (2, "bad bad awful"), (3, "good and bad"), (4, None), (5, ""), (6, "Unknown words ÉÉ"), (None, "good")]


def lexicon_by_hand(labels, prior):
    words = {1: ["good", "good", "nice"], 2: ["bad", "bad", "awful"], 3: ["good", "and", "bad"], 6: ["unknown", "words", "éé"], None: ["good"]}
    every = [w for ws in words.values() for w in ws]
    of = lambda label: [w for k, ws in words.items() if labels.get(k) == label for w in ws]
    out = {}
    for w in set(every):
        a = prior * every.count(w) / len(every)
        odds = [math.log((c.count(w) + a) / (len(c) + prior - c.count(w) - a)) for c in (of(1), of(0))]
        out[w] = odds[0] - odds[1]
    return out


def test_weights_and_scores_by_hand(spark):
    texts = spark.createDataFrame(TEXTS, "id long, body string")
    labels = {1: 1, 2: 0, 3: 7}
    counts = sentiment.word_counts(texts, "id", "body")
    lexicon = sentiment.learn_lexicon(counts, spark.createDataFrame(list(labels.items()), "key long, label int"), prior=10.0, least_z=0.0)
    wanted = lexicon_by_hand(labels, 10.0)
    got = {r.word: r.weight for r in lexicon.collect()}
    assert set(got) == set(wanted) and all(math.isclose(got[w], wanted[w], abs_tol=1e-12) for w in wanted)
    scored = {r.key: (r.n_words, r.n_hits, r.score) for r in sentiment.score_texts(texts, "id", counts, lexicon).collect()}
    assert scored[4] == scored[5] == (0, 0, 0.0) and scored[None][0] == 1
    assert math.isclose(scored[1][2], (2 * wanted["good"] + wanted["nice"]) / 3) and scored[1][2] > 0 > scored[2][2]


def test_unsure_words_are_left_out(spark):
    texts = spark.createDataFrame([(i, "fine same") for i in range(50)] + [(100 + i, "poor same") for i in range(50)], "id long, body string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(50), *range(100, 150)]], "key long, label int")
    lexicon = sentiment.learn_lexicon(sentiment.word_counts(texts, "id", "body"), labels, prior=1.0)
    assert [r[0] for r in rows(lexicon, "word")] == ["fine", "poor"]


def test_no_texts(spark):
    texts = spark.createDataFrame([], "id long, body string")
    counts = sentiment.word_counts(texts, "id", "body")
    lexicon = sentiment.learn_lexicon(counts, spark.createDataFrame([], "key long, label int"))
    assert sentiment.score_texts(texts, "id", counts, lexicon).collect() == []
