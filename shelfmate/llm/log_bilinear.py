"""Scoring texts with a log-bilinear neural language model, and with a smoothed unigram base.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token per text.

Model. The most frequent words have a class each; every other word falls into one of RARE classes by its last two
bytes, so that word endings, and with them the language, stay visible. A token's probability is
P(class | previous class) * P(word | class), the latter (c + 1) / (N + V + 1) among the class's training words (1 for a
class of one word). The first factor is log-bilinear: context vector r of the previous class, target vector q
and bias b per class, s = r q + b, normalised over all classes.

Training. Noise-contrastive estimation in numpy. The data are the counts of adjacent classes over all training
tokens, summed by Spark: a table of at most classes^2 cells, whatever the corpus. On these counts both sides of the
NCE objective, the data and the expectation over the noise distribution (unigram, NOISE draws per token),
are exact, so each step is three matrix products over the whole corpus and nothing is sampled. Every context
gets SMOOTHING pseudo-tokens, so that rare contexts stay near the unigram.

Scoring. One batched matrix product gives the normalised log-probabilities of all (context, class) pairs,
a table of classes^2 numbers that is broadcast; tasks only look it up. Counts of words that make up at least a
share FREQUENT of the tokens (at most 1 / FREQUENT words) are broadcast by hash too; rarer words of a text are
joined with their counts, and as none of them is frequent, no key is hot.

Words are identified by 64-bit xxh3 hashes.

Defined results: a null text counts as empty and has one token, the end. With no training texts N = V = 0. A
null doc_id hashes as empty text. Repeated rows are scored each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.llm.common import crc_mod, prepare, read_table, through_table
from shelfmate.operators.joins import splittable_join

SHORT, RARE = 767, 256
DIMENSIONS, NOISE, STEPS, RATE = 32, 10, 200, 0.05
#: Pseudo-tokens, distributed like single classes, that each context has beside its own.
SMOOTHING = 10.0
FREQUENT = 2e-6
FOLDS, HELD_OUT = 7, 2
#: Up to so many classes a task adds its pairs up in a table; beyond, it hands on the pairs of each piece.
DENSE = 2048

END = b"\n"  # no word contains it
_FLUSH = 200_000
_PIECE = 1 << 21


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()  # bytes: only A-Z change, only the six blanks split
    words.append(END)
    return words


def hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class Classes:
    """Class of a word: its place among the frequent words, or a class of rare words by its last two bytes."""

    def __init__(self, short: np.ndarray):
        self.place = {int(h): i for i, h in enumerate(short)}
        self.n_short = len(short)
        self.size = self.n_short + RARE

    def of(self, words: list[bytes], hashed: np.ndarray) -> np.ndarray:
        place, n = self.place, self.n_short
        found = [place.get(h, -1) for h in hashed.tolist()]
        return np.array([c if c >= 0 else n + zlib.crc32(w[-2:]) % RARE for c, w in zip(found, words)], np.int64)


def _pieces(column: pa.Array):
    """Tokens of whole texts, about _PIECE bytes at a time: first row, lengths, distinct words, index of every token."""
    start, size, split = 0, 0, []
    last = len(column) - 1
    for i, text in enumerate(column.cast(pa.binary())):
        raw = text.as_py()
        split.append(tokens(raw))
        size += len(raw or b"")
        if size >= _PIECE or i == last:
            place: dict[bytes, int] = {}
            for words in split:
                for word in words:
                    if word not in place:
                        place[word] = len(place)
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            index = np.fromiter((place[w] for words in split for w in words), np.int64, int(lengths.sum()))
            yield start, lengths, list(place), index
            start, size, split = i + 1, 0, []


# --- corpus statistics -----------------------------------------------------------------


def _count_words(batches):
    counts: Counter = Counter()

    def rows():
        words = list(counts)
        ends = [zlib.crc32(w[-2:]) % RARE for w in words]
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes(words)), pa.array(ends, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "ending", "n"]
        )

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update(tokens(text.as_py()))
            if len(counts) >= _FLUSH:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def _count_pairs(classes):
    def run(batches):
        n = classes.value.size
        dense = n <= DENSE
        counts = np.zeros(n * n if dense else 0, np.int64)

        def rows(cells, numbers):
            for start in range(0, len(cells), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(cells[part]), pa.array(numbers[part])], names=["cell", "n"])

        for batch in batches:
            for _, lengths, words, index in _pieces(batch.column(0)):
                cls = classes.value.of(words, hashes(words))[index]
                ends = np.cumsum(lengths)
                before = np.concatenate([[0], cls[:-1]])
                before[np.concatenate([[0], ends[:-1]])] = classes.value.place[_END_HASH]  # a text starts after an end
                if dense:
                    counts += np.bincount(before * n + cls, minlength=n * n)
                else:
                    yield from rows(*np.unique(before * n + cls, return_counts=True))
        cells = np.flatnonzero(counts)
        yield from rows(cells, counts[cells])

    return run


_END_HASH = int(hashes([END])[0])


# --- the model -----------------------------------------------------------------------------


def train(counts: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 5):
    """(r, q, b) by NCE on a table of counts (context, target)."""
    n = len(counts)
    draw = np.random.default_rng(seed)
    counts = counts + SMOOTHING * (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)
    total = float(counts.sum())
    data = (counts / total).astype(np.float32)
    unigram = ((counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)).astype(np.float32)
    against = np.outer(data.sum(1), unigram) * np.float32(noise)
    log_noise = np.log(unigram * np.float32(noise))
    parts = [
        draw.normal(0, 0.1, (n, dimensions)).astype(np.float32),
        draw.normal(0, 0.1, (n, dimensions)).astype(np.float32),
        np.log(unigram),
    ]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        r, q, b = parts
        odds = r @ q.T + (b - log_noise)
        is_data = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        g = against * is_data - data * (1 - is_data)
        grads = [g @ q, g.T @ r, g.sum(0)]
        for k, (part, grad) in enumerate(zip(parts, grads)):
            grad = grad + np.float32(1e-7) * part
            means[k] = 0.9 * means[k] + 0.1 * grad
            squares[k] = 0.99 * squares[k] + 0.01 * grad * grad
            scale = rate * (1 - step / (steps + 1))
            part -= scale * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-9)
    return parts


def log10_table(r: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities (context, class)."""
    s = (r @ q.T + b).astype(np.float64)
    top = s.max(1, keepdims=True)
    s -= top + np.log(np.exp(s - top).sum(1, keepdims=True))
    return (s / np.log(10)).astype(np.float32)


class Scorer:
    def __init__(self, classes: Classes, table: np.ndarray, class_total: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]):
        self.classes, self.table = classes, table
        self.class_total = class_total  # log10(N + V + 1) of a class of rare words; 0 for a class of one word
        order = np.argsort(frequent[0])
        self.words, self.log_count = frequent[0][order], np.log10(frequent[1][order] + 1.0)


def _score(scorer, total: int, distinct: int):
    def run(batches):
        s = scorer.value
        n_short, end = s.classes.n_short, s.classes.place.get(_END_HASH)
        per_token = np.log10(total + distinct + 1)
        for batch in batches:
            for start, lengths, words, index in _pieces(batch.column(1)):
                hashed = hashes(words)
                at = np.minimum(np.searchsorted(s.words, hashed), max(len(s.words) - 1, 0))
                listed = s.words[at] == hashed if len(s.words) else np.zeros(len(words), bool)
                log_count = np.where(listed, s.log_count[at] if len(s.words) else 0.0, 0.0)
                cls = s.classes.of(words, hashed)
                firsts = np.cumsum(lengths) - lengths
                token_class = cls[index]
                before = np.concatenate([[0], token_class[:-1]])
                before[firsts] = end if end is not None else 0
                # The word's share of its class: log10(c + 1) is added here or, for rare words, after the join.
                word = np.where(cls < n_short, 0.0, np.where(listed, log_count, 0.0) - s.class_total[cls])
                model = np.add.reduceat(s.table[before, token_class] + word[index], firsts)
                base = np.add.reduceat((log_count - per_token)[index], firsts)
                known = np.add.reduceat(listed[index].astype(np.int64), firsts)
                rare_words, rare_counts = [], []
                unlisted = ~listed[index]
                for first, length in zip(firsts.tolist(), lengths.tolist()):
                    some, n = np.unique(hashed[index[first : first + length][unlisted[first : first + length]]], return_counts=True)
                    rare_words.append(some)
                    rare_counts.append(n)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare_words])]).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (rare_words, rare_counts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(lengths)), pa.array(lengths), pa.array(known), pa.array(base), pa.array(model), *lists],
                    names=["doc_id", "n_tokens", "n_known", "base", "model", "words", "counts"],
                )

    return run


def score(docs: DataFrame, short: int = SHORT, frequent: float = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.col("text").alias("_text"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("_held"))
    learn = rows.where(~F.col("_held")).select("_text")
    counted = learn.mapInArrow(_count_words, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    counted = through_table(counted, "lm-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    top = counted.where(F.col("word") != _END_HASH).orderBy(F.desc("n"), "word").limit(short).select("word").toArrow()
    top_words = np.append(top.column("word").to_numpy(), _END_HASH).astype(np.int64)
    classes = Classes(top_words)
    shared = spark.sparkContext.broadcast(classes)
    cells = learn.mapInArrow(_count_pairs(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(classes.size**2)
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = log10_table(*train(pairs.reshape(classes.size, classes.size)))

    is_short = F.col("word").isin([int(w) for w in top_words])
    per_ending = counted.where(~is_short).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    class_total = np.zeros(classes.size)
    endings = classes.n_short + per_ending.column("ending").to_numpy()
    class_total[endings] = np.log10(per_ending.column("n").to_numpy() + per_ending.column("v").to_numpy() + 1.0)
    often = F.col("n") >= F.lit(max(1.0, frequent * total))
    listed = counted.where(often).select("word", "n").toArrow()
    scorer = spark.sparkContext.broadcast(
        Scorer(classes, table, class_total, (listed.column("word").to_numpy().astype(np.int64), listed.column("n").to_numpy()))
    )
    scored = rows.select(F.struct("doc_id", "_held").alias("_id"), "_text").mapInArrow(
        _score(scorer, total, distinct),
        f"doc_id struct<doc_id:{rows.dtypes[0][1]},_held:boolean>, n_tokens long, n_known long, base double, model double, "
        "words array<long>, counts array<long>",
    )
    scored = through_table(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("_row", "x.words", "x.counts")
    met = splittable_join(rare.withColumnRenamed("words", "word"), counted.where(~often).select("word", "n"), ["word"], "inner")
    per_row = met.groupBy("_row").agg(
        F.sum(F.col("counts") * F.log10(F.col("n") + 1)).alias("_log"), F.sum("counts").alias("_known")
    )
    log, known = F.coalesce("_log", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return scored.select("_row", "doc_id.*", "n_tokens", "n_known", "base", "model").join(per_row, "_row", "left").select(
        "doc_id",
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )


def query(spark, sf_dir):
    return score(read_table(spark, sf_dir, "documents"))
