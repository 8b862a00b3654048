"""Sentiment by a lexicon that is learned from labelled texts; no word list is part of the code.

A word weighs its log-odds between positive and negative texts with an informative Dirichlet prior (Monroe, Colaresi and
Quinn, Fightin' Words, 2008): ``prior`` imagined words spread like the whole corpus. Words whose weight is less than ``least_z``
standard errors from zero are left out.

Defined results: a null text has no words; a text without lexicon words scores 0. Repeated keys count as one text.
Texts without a label enter the prior alone; a label that is neither 0 nor 1 is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.operators.joins import splittable_join

PRIOR, LEAST_Z = 1000.0, 1.96
WORDS = r"\p{L}+"


def word_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): words are runs of letters in lower case."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))
    return texts.select(F.col(key).alias("key"), words.alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(counts: DataFrame, labels: DataFrame, prior: float = PRIOR, least_z: float = LEAST_Z) -> DataFrame:
    """(word, weight, z) from ``word_counts`` and labels (key, label), one per key: 1 is positive, 0 negative."""
    marked = counts.join(labels.select("key", "label"), "key", "left")

    def of(label: int):
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))

    words = marked.groupBy("word").agg(F.sum("n").alias("n"), of(1).alias("n1"), of(0).alias("n0"))
    totals = words.agg(F.sum("n").alias("t"), F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    both = words.join(F.broadcast(totals))  # one row
    imagined = F.lit(prior) * F.col("n") / F.col("t")

    def odds(count: str, total: str):
        return F.log((F.col(count) + imagined) / (F.col(total) + F.lit(prior) - F.col(count) - imagined))

    error = F.sqrt(1 / (F.col("n1") + imagined) + 1 / (F.col("n0") + imagined))
    # A single word that is the whole corpus has infinite odds and tells nothing.
    weighed = both.where(F.col("n") < F.col("t")).select("word", (odds("n1", "t1") - odds("n0", "t0")).alias("weight"), error.alias("error"))
    return weighed.select("word", "weight", (F.col("weight") / F.col("error")).alias("z")).where(F.abs("z") >= least_z)


def score_texts(texts: DataFrame, key: str, counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key, n_words, n_hits, score): the mean weight of a text's lexicon words, for every key of ``texts``."""
    hits = splittable_join(counts, lexicon.select("word", "weight"), ["word"], "left")
    scored = hits.groupBy("key").agg(
        F.sum("n").alias("n_words"),
        F.sum(F.when(F.col("weight").isNotNull(), F.col("n"))).alias("n_hits"),
        F.sum(F.col("n") * F.col("weight")).alias("total"),
    )
    asked = texts.select(F.col(key).alias("key")).distinct()
    joined = asked.alias("a").join(scored.alias("s"), F.col("a.key").eqNullSafe(F.col("s.key")), "left")
    return joined.select(
        F.col("a.key").alias("key"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_words", "n_hits")],
        F.coalesce(F.col("total") / F.col("n_hits"), F.lit(0.0)).alias("score"),
    )
