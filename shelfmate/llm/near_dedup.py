"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Weights. A text is the multiset of its five-word shingles (a text of one to four words is one shingle). A
shingle weighs its count times its IDF, the mean over its words of 1 + ln(1 / max(df / N, RARE)). Word frequencies are
counted over all documents. They stand in for frequencies of whole shingles for two reasons: nearly all shingles occur
once, and a shingle's own frequency would punish exactly the copies that are looked for: in a group of thousands of
near copies the shared shingles would weigh a fraction of the edited ones, and the group would fall apart as it
grows. RARE is a share of the documents, so weights do not depend on the size of the corpus, and
there are at most (mean distinct words of a document) / RARE frequent words, which are broadcast.

Sampling. Improved consistent weighted sampling (Ioffe, 2010): per hash, a shingle of weight w draws r, c ~ Gamma(2, 1) and
beta ~ U(0, 1), t = floor(ln w / r + beta), a = ln c - r (t - beta + 1); the smallest a wins with (shingle, t).
Two texts agree with probability equal to their weighted Jaccard similarity. 14 bands of 4 find a
pair at 0.8 with probability 0.9994.

Verifying. Exact copies (equal word sequences) are one node. In a bucket, first every member is compared with the
bucket's hub, the member that meets most others over all bands; hub links make components. With ``hub_rounds``, where a bucket
is still in several components, ``hubs_a_round`` members outside its largest one are compared with all members, in rows linear in
the bucket; then all links of these hubs are known and they leave the bucket. In
a bucket that is still in several components, two members can only be similar, and not both linked to the hub, if they share
enough of what tells them from the hub (``prefixes``). So each gives the rarest-looking part of that, and those that share
one of these features and a hub are compared, in tiles of up to about BLOCK x BLOCK texts. Copies that
each have edits of their own share few such features, so a large group of them makes rows in proportion to its size; where
one feature is shared by many, they are all compared. No link inside a bucket that would join two components
is missed, no list of pairs is ever made, and a tile returns at most a spanning forest of its links.

Classes are the connected components of the links. Defined results: a null text counts as empty; a text without
words is in a class of its own. The class id is the smallest doc_id in the class (null only if all are null). The row with that
doc_id stays; of rows that repeat it, one. Only the key and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmate.llm.common import WHITE, prepare, read_table, row_hash, through_table, whole_row
from shelfmate.llm.components import components
from shelfmate.operators.joins import splittable_join

WORDS = 5
SIMILARITY = 0.8
RARE = 1e-3
BANDS, ROWS = 14, 4
BLOCK = 128
#: Hubs of a bucket in each further round, and most such rounds before what is left is compared in tiles. None unless asked
#: for: they pay where large groups hang together by chains of links, and cost time where a group is mostly unlike.
HUBS, HUB_ROUNDS = 64, 0

#: Bytes of text that a worker holds shingles of at a time; what it once held it keeps until it ends.
_PIECE = 1 << 19
_FLUSH = 200_000
_U = np.uint64
_ODD32 = np.uint32(0x9E3779B1)
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


# --- shingles and weights ------------------------------------------------------------------


def _scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _M2
    z = (z ^ (z >> _U(27))) * _M3
    return z ^ (z >> _U(31))


class Idf:
    """Weights of words by hash; words not listed have the weight of a rare one."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, rare: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.rare = hashes[order], weights[order].astype(np.float32), np.float32(rare)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.hashes) == 0:
            return np.full(len(hashes), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], self.rare)


def shingles(split: list[list[bytes]], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by (text, hash): text number, hash, count, IDF."""
    place: dict[bytes, int] = {}
    for words in split:
        for word in words:
            if word not in place:
                place[word] = len(place)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, place), _U, len(place))
    weight = idf.of(hashed)
    n = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((place[word] for words in split for word in words), np.int64, int(n.sum()))
    starts = np.cumsum(n) - n
    h, w = hashed[ids], weight[ids]
    many = np.maximum(n - WORDS + 1, 0)
    first = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    code, mean = np.full(len(first), _U(WORDS)), np.zeros(len(first), np.float32)
    for i in range(WORDS):
        code = _scramble(code * _M1 + h[first + i])
        mean += w[first + i]
    text = np.repeat(np.arange(len(split)), many)
    mean /= np.float32(WORDS)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        codes, means = [], []
        for t in short:
            z = np.array([n[t]], _U)
            for i in range(starts[t], starts[t] + n[t]):
                z = _scramble(z * _M1 + h[i : i + 1])
            codes.append(z)
            means.append(w[starts[t] : starts[t] + n[t]].mean())
        code, mean, text = np.concatenate([code, *codes]), np.concatenate([mean, np.array(means, np.float32)]), np.concatenate([text, short])
    order = np.lexsort((code, text))
    code, mean, text = code[order], mean[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(code))), mean[at]


# --- consistent weighted sampling ------------------------------------------------------------


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - exp(-x) (1 + x), by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Signatures of (text, shingle, weight) rows; draws come from 16 bits of a hash each."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        grid = _gamma2((np.arange(65536) + 0.5) / 65536)
        self.r, self.log_c = grid.astype(np.float32), np.log(grid).astype(np.float32)
        self.bands, self.rows = bands, rows
        self.odd = _scramble(np.arange(1, bands * rows + 1, dtype=_U) * _M1) | _U(1)

    def smallest(self, code: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, hashes): the winning sample of each text; texts start at ``starts`` and are not empty.

        A sample is one 64-bit number, a in the order of integers above 32 bits that follow from (shingle, t).
        """
        n = len(code)
        out = np.empty((len(starts), len(self.odd)), np.int64)
        z, shifted, entry = np.empty(n, _U), np.empty(n, _U), np.empty((n, 2), np.uint32)
        draws, halves = z.view(np.uint16).reshape(n, 4), z.view(np.uint32).reshape(n, 2)
        for k, odd in enumerate(self.odd):
            np.multiply(code, odd, out=z)
            z ^= np.right_shift(z, _U(29), out=shifted)
            z *= _M2
            z ^= np.right_shift(z, _U(32), out=shifted)
            r = self.r[draws[:, 0]]
            beta = draws[:, 2] * np.float32(1 / 65536)
            t = np.floor(log_w / r + beta)
            a = self.log_c[draws[:, 1]] - r * (t - beta + np.float32(1))
            order = a.view(np.int32)
            order ^= (order >> 31) & np.int32(0x7FFFFFFF)  # floats in the order of integers
            sample = halves[:, 1] ^ (t.astype(np.int32).view(np.uint32) * _ODD32)
            sample ^= halves[:, 0] * _ODD32
            entry[:, 0], entry[:, 1] = sample * _ODD32, order.view(np.uint32)
            out[:, k] = np.minimum.reduceat(entry.view(np.int64)[:, 0], starts)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        keys = np.empty((len(samples), self.bands), np.int64)
        for b in range(self.bands):
            z = np.full(len(samples), _U(b + 1))
            for i in range(b * self.rows, (b + 1) * self.rows):
                z = _scramble(z * _M1 + samples[:, i].view(_U))
            keys[:, b] = z.view(np.int64)
        return keys


def _pieces(texts: list[bytes]):
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _PIECE:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# --- document frequencies ---------------------------------------------------------------------


def _count_words(batches):
    counts: Counter = Counter()

    def rows():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), _U, len(counts)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update(set((text.as_py() or b"").split()))
            if len(counts) >= _FLUSH:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_weights(docs: DataFrame, text: str = "text", rare: float = RARE) -> Idf:
    """IDF of the words that at least a share ``rare`` of the documents has; the number of those words is bounded."""
    prepare(docs.sparkSession)
    total = docs.count()
    counts = docs.select(F.col(text)).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > F.lit(rare * total)).toArrow()
    n = often.column("n").to_numpy()
    return Idf(often.column("word").to_numpy().view(_U), 1 + np.log(total / np.maximum(n, 1)), 1 + np.log(1 / rare))


# --- signatures -------------------------------------------------------------------------------


def word_digest(text: Column) -> Column:
    """MD5 of the words joined by single spaces; null for a text without words. Computed here and in tasks alike."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " "))
    return F.when(F.length(joined) > 0, F.md5(joined.cast("binary")))


def _signatures(idf, bands: int, rows: int):
    def run(batches):
        sampler = Sampler(bands, rows)
        for batch in batches:
            at = 0
            for piece in _pieces(_texts(batch.column(1))):
                split = [t.split() for t in piece]
                digests = [hashlib.md5(b" ".join(w)).hexdigest() if w else None for w in split]
                text, code, count, weight = shingles(split, idf.value)
                log_w = np.log(count.astype(np.float32) * weight)
                present, starts = np.unique(text, return_index=True)
                keys = [[] for _ in piece]
                total = np.zeros(len(piece))
                if len(present):
                    total[present] = np.add.reduceat(count * weight.astype(np.float64), starts)
                    ends = np.append(starts[1:], len(code))
                    low = 0
                    while low < len(starts):  # blocks of shingles that stay in the processor's cache
                        high = max(low + 1, int(np.searchsorted(ends, starts[low] + 32768, side="right")))
                        part = slice(starts[low], ends[high - 1])
                        samples = sampler.smallest(code[part], log_w[part], starts[low:high] - starts[low])
                        for t, row in zip(present[low:high], sampler.band_keys(samples).tolist()):
                            keys[t] = row
                        low = high
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(piece)), pa.array(digests, pa.string()), pa.array(total), pa.array(keys, pa.list_(pa.int64()))],
                    names=["key", "node", "total", "bands"],
                )
                at += len(piece)

    return run


# --- verifying --------------------------------------------------------------------------------


class _Tile:
    """Texts of one tile: rows (side 0) against columns (side 1)."""

    def __init__(self, texts: list[bytes], idf: Idf):
        text, code, count, weight = shingles([t.split() for t in texts], idf)
        # An occurrence is a feature of its own: the smaller of two counts is the number of shared ones.
        self.text = np.repeat(text, count)
        occurrence = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        self.code = _scramble(np.repeat(code, count) + occurrence.astype(_U) * _M1)
        self.weight = np.repeat(weight, count).astype(np.float64)
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        sums = np.concatenate([[0.0], np.cumsum(self.weight)])
        self.total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def similar(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of each row text with each column text."""
        take = lambda of: np.concatenate([np.arange(self.bounds[t], self.bounds[t + 1]) for t in of])
        left, right = take(rows), take(columns)
        shared = np.zeros((len(rows), len(columns)))
        common = np.intersect1d(self.code[left], self.code[right])
        row_of = np.repeat(np.arange(len(rows)), np.diff(self.bounds)[rows])
        column_of = np.repeat(np.arange(len(columns)), np.diff(self.bounds)[columns])
        if len(common):

            def place(features, owner):
                at = np.minimum(np.searchsorted(common, self.code[features]), len(common) - 1)
                there = common[at] == self.code[features]
                order = np.argsort(at[there], kind="stable")
                return at[there][order], owner[there][order], self.weight[features][there][order]

            at_l, who_l, w_l = place(left, row_of)
            at_r, who_r, _ = place(right, column_of)
            for start in range(0, len(common), 4096):
                stop = min(start + 4096, len(common))
                l0, l1 = np.searchsorted(at_l, (start, stop))
                r0, r1 = np.searchsorted(at_r, (start, stop))
                a, b = np.zeros((len(rows), stop - start)), np.zeros((len(columns), stop - start))
                a[who_l[l0:l1], at_l[l0:l1] - start] = w_l[l0:l1]
                b[who_r[r0:r1], at_r[r0:r1] - start] = 1.0
                shared += a @ b.T
        either = self.total[rows][:, None] + self.total[columns][None, :] - shared
        return shared / np.maximum(either, 1e-12)


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _verify(idf, similarity: float):
    def links(tiles: list[tuple[list[str], list[int], list[bytes]]]):
        """Links of several whole tiles; their shingles are made together."""
        made, at, found = _Tile([t for _, _, texts in tiles for t in texts], idf.value), 0, []
        for nodes, sides, texts in tiles:
            side = np.array(sides)
            rows, columns = at + np.flatnonzero(side == 0), at + np.flatnonzero(side == 1)
            if len(rows) and len(columns):
                hit = np.argwhere(made.similar(rows, columns) >= similarity - 1e-9)
                pairs = np.column_stack([rows[hit[:, 0]] - at, columns[hit[:, 1]] - at])
                found += [(nodes[a], nodes[b]) for a, b in _forest(pairs, len(texts))]
            at += len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["a", "b"]
        )

    def run(batches):
        for tiles in _whole_tiles(batches):
            yield links([tile[:3] for tile in tiles])

    return run


def _whole_tiles(batches):
    """Lists of whole tiles (nodes, sides, texts, roots), of about _PIECE bytes of text each."""
    name, tile, whole, size = None, ([], [], [], []), [], 0
    for batch in batches:
        for at, node, side, text, root in zip(*(batch.column(i) for i in range(5))):
            if at.as_py() != name:
                if tile[0]:
                    whole.append(tile)
                    if size >= _PIECE:
                        yield whole
                        whole, size = [], 0
                name, tile = at.as_py(), ([], [], [], [])
            for column, value in zip(tile, (node.as_py(), side.as_py(), text.as_py().encode(), root.as_py())):
                column.append(value)
            size += len(tile[2][-1])
    if tile[0]:
        yield [*whole, tile]


def prefixes(codes: np.ndarray, weights: np.ndarray, hub_codes: np.ndarray, hub_weights: np.ndarray, similarity: float):
    """What a text and its hub do not share, in one order for all texts of the hub; and how many of these features the text asks
    with (0 if it is linked to the hub) and is found by.

    x and y are similar if what they do not share weighs at most k (|x| + |y|), k = (1 - s) / (1 + s). With D(x) for what x does not
    share with the hub that is |D(x)| + |D(y)| - 2 |D(x) & D(y)|; so similar texts share at least (|D(x)| + |D(y)| - k (|x| + |y|)) / 2
    of their differences. Where x is not linked to the hub, |D(x)| > k (|x| + |hub|), which is more than 0 for every y but the hub's
    equals. As |x| <= |y| / s and |D(x)| >= |D(y)| - k (|x| + |y|), it is also at least |D(y)| - |y| (1 - s) / s. The first
    shared feature lies before the rest that weighs less than that, on both sides.
    """
    added = ~np.isin(codes, hub_codes)
    gone = ~np.isin(hub_codes, codes)
    feature, weight = np.concatenate([codes[added], hub_codes[gone]]), np.concatenate([weights[added], hub_weights[gone]])
    late = np.repeat([0, 1], [added.sum(), gone.sum()])  # what most texts of the hub lack comes last
    order = np.lexsort((feature, -weight, late))
    sums = np.cumsum(weight[order])
    own, hub, apart = weights.sum(), hub_weights.sum(), sums[-1] if len(sums) else 0.0
    shared = weights[~added].sum()
    linked = shared / max(own + hub - shared, 1e-12) >= similarity - 1e-9
    k, least = (1 - similarity) / (1 + similarity), apart - own * (1 - similarity) / max(similarity, 1e-9)
    slack = 1e-6 * (own + hub)

    def first(need: float) -> int:
        return min(len(sums), int(np.searchsorted(sums, apart - max(need, least) + slack, side="right")) + 1)

    asks = 0 if linked else first((apart - k * (own + hub)) / 2)
    return feature[order], asks, first((apart - k * (own - hub)) / 2)


def _differences(idf, similarity: float):
    def run(batches):
        for tiles in _whole_tiles(batches):
            made, at = _Tile([t for _, _, texts, _ in tiles for t in texts], idf.value), 0
            hubs, nodes, roots, found, asks, told = [], [], [], [], [], []
            for names, sides, texts, root in tiles:
                of = [slice(made.bounds[i], made.bounds[i + 1]) for i in range(at, at + len(texts))]
                hub = sides.index(0)
                for i in range(len(texts)):
                    if i == hub:
                        continue
                    feature, n_asks, n_told = prefixes(
                        made.code[of[i]], made.weight[of[i]], made.code[of[hub]], made.weight[of[hub]], similarity
                    )
                    n = max(n_asks, n_told)
                    hubs += [names[hub]] * n
                    nodes += [names[i]] * n
                    roots += [root[i]] * n
                    found.append(feature[:n].view(np.int64))
                    asks.append(np.arange(n) < n_asks)
                    told.append(np.arange(n) < n_told)
                at += len(texts)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hubs), pa.array(nodes), pa.array(roots), *(pa.array(np.concatenate(c)) for c in (found, asks, told))],
                    names=["hub", "node", "root", "feature", "asks", "told"],
                )

    return run


def _in_tiles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: (tile, node, side) or (tile, node, side, root); a tile has bounded rows, and none is dropped."""
    rooted = members if "root" in members.columns else members.withColumn("root", F.lit(None).cast("string"))
    rows = splittable_join(rooted.distinct(), texts, ["node"], "inner").select("tile", "node", "side", "text", "root")
    return rows.repartition("tile").sortWithinPartitions("tile")


def _links(members: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links inside tiles."""
    return _in_tiles(members, texts).mapInArrow(_verify(idf, similarity), "a string, b string")


def _about_hubs(spokes: DataFrame, block: int) -> DataFrame:
    """Tiles of (hub, node) rows: up to about 2 x ``block`` nodes on one side, their hub on the other. Other columns are kept."""
    blocks = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)).alias("blocks"))
    more = [c for c in spokes.columns if c not in ("hub", "node")]
    spokes = splittable_join(spokes, blocks, ["hub"], "inner")
    tile = F.concat_ws("/", "hub", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spokes = spokes.select(tile.alias("tile"), "hub", "node", *more)
    hubs = spokes.select("tile", F.col("hub").alias("node"), F.lit(0).alias("side"), *(F.lit(None).alias(c) for c in more))
    return spokes.select("tile", "node", F.lit(1).alias("side"), *more).unionAll(hubs)


def _unresolved(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, outside) of the buckets whose members are in several components; ``outside`` are the members
    that are not in the bucket's largest one."""
    rooted = splittable_join(met, roots, ["node"], "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("_largest"), F.count(F.lit(1)).alias("_parts"))
    whole = whole.where("_parts > 1").select("bucket", F.col("_largest.root").alias("_root"))
    return splittable_join(rooted, whole, ["bucket"], "inner").select("bucket", "node", (F.col("root") != F.col("_root")).alias("outside"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (a, b): only the components that the links touch are worked on."""
    ends = links
    for end in ("a", "b"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        ends = splittable_join(ends, at, [end], "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    onward = components(ends)
    moved = splittable_join(roots, onward.select(F.col("node").alias("root"), F.col("root").alias("_root")), ["root"], "left")
    fresh = splittable_join(onward, roots.select("node"), ["node"], "left_anti")
    return moved.select("node", F.coalesce("_root", "root").alias("root")).unionAll(fresh.select("node", "root"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY, bands: int = BANDS,
                 rows: int = ROWS, block: int = BLOCK, hubs_a_round: int = HUBS, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per document: key, node (digest of its words), class_id, class_size, kept."""
    spark = docs.sparkSession
    prepare(spark)
    idf = spark.sparkContext.broadcast(word_weights(docs, text))
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    signed = through_table(
        narrow.mapInArrow(_signatures(idf, bands, rows), "key long, node string, total double, bands array<long>"), "near-signatures"
    )
    # Exact copies are one node; they agree in everything, so any row's signature is the node's.
    nodes = signed.where("node is not null").dropDuplicates(["node"])
    in_bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = through_table(splittable_join(in_bucket, sizes, ["bucket"], "inner"), "near-buckets")
    texts = narrow.select(word_digest(F.col("_text")).alias("node"), F.col("_text").alias("text"))
    # Split where one text has very many exact copies; one text a node is left.
    texts = splittable_join(texts, met.select("node").distinct(), ["node"], "left_semi").dropDuplicates(["node"])
    texts = through_table(texts, "near-texts")

    # First round: every member against its bucket's hub.
    central = met.groupBy("node").agg(F.sum("n").alias("reach"))
    reached = met.select("bucket", "node", "n").join(central, "node")
    hubs = reached.groupBy("bucket").agg(F.max(F.struct("reach", "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"))
    hubs = through_table(hubs, "near-bucket-hubs")
    spokes = splittable_join(met.select("bucket", "node"), hubs, ["bucket"], "inner").where("node <> hub").select("hub", "node").distinct()
    members = _about_hubs(through_table(spokes, "near-spokes"), block)
    first = through_table(_links(members, texts, idf, similarity), "near-links")
    roots = through_table(components(first), "near-roots")

    # Further rounds: many hubs at once, chosen among those outside the largest component of a bucket.
    for _ in range(hub_rounds):
        still = through_table(_unresolved(met, roots), "near-open")
        draw = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
        chosen = still.where("outside").withColumn("_place", F.row_number().over(draw)).where(F.col("_place") <= hubs_a_round)
        chosen = through_table(chosen.select("bucket", F.col("node").alias("hub")), "near-hubs")
        if chosen.isEmpty():
            break
        blocks = still.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)).alias("blocks"))
        named = lambda at: F.concat_ws("/", "bucket", at).alias("tile")
        compared = splittable_join(still.select("bucket", "node"), blocks, ["bucket"], "inner")
        compared = compared.select(named(F.pmod(F.xxhash64("node"), F.col("blocks"))), "node", F.lit(1).alias("side"))
        asking = chosen.join(blocks, "bucket").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asking = asking.select(named(F.col("_at")), F.col("hub").alias("node"), F.lit(0).alias("side"))
        found = through_table(_links(compared.unionAll(asking), texts, idf, similarity).where("a <> b").distinct(), "near-hub-links")
        # All links of a hub in its bucket are known now, so it takes no further part there.
        met = splittable_join(still.select("bucket", "node"), chosen.withColumnRenamed("hub", "node"), ["bucket", "node"], "left_anti")
        met = through_table(met, "near-left")
        if found.isEmpty():
            break
        roots = through_table(_joined(roots, found), "near-roots")

    # Last round: what is still in several components, by what the texts do not share with their bucket's hub.
    still = splittable_join(_unresolved(met, roots).select("bucket", "node"), hubs, ["bucket"], "inner")
    still = still.where("node <> hub").select("hub", "node").distinct()
    still = splittable_join(still, roots, ["node"], "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    members = _about_hubs(through_table(still, "near-open"), block)
    differences = _in_tiles(members, texts).mapInArrow(
        _differences(idf, similarity), "hub string, node string, root string, feature long, asks boolean, told boolean"
    )
    differences = through_table(differences, "near-differences")
    count = lambda flag: F.ceil(F.sum(F.col(flag).cast("int")) / F.lit(block))
    # Features that the same texts share make one tile: its members are told by two sums of hashes.
    told_by = [F.sum(F.xxhash64(F.lit(n), "node", "asks", "told").cast("decimal(38,0)")).alias(f"_by{n}") for n in (0, 1)]
    shared = differences.groupBy("hub", "feature").agg(
        count("asks").alias("blocks0"), count("told").alias("blocks1"), F.min("root").alias("_low"), F.max("root").alias("_high"), *told_by
    )
    shared = shared.where("blocks0 > 0 and blocks1 > 0 and _low <> _high")
    shared = shared.groupBy("hub", "_by0", "_by1", "blocks0", "blocks1").agg(F.min("feature").alias("feature")).drop("_by0", "_by1")
    placed = splittable_join(differences, shared, ["hub", "feature"], "inner")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def side(which: int, chosen: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col(f"blocks{which}"))
        at = chosen.withColumn("_own", own).withColumn("_other", upto(f"blocks{1 - which}"))
        blocks = ("_own", "_other") if which == 0 else ("_other", "_own")
        return at.select(F.concat_ws("/", "hub", "feature", *blocks).alias("tile"), "node", F.lit(which).alias("side"))

    members = side(0, placed.where("asks")).unionAll(side(1, placed.where("told")))
    last = through_table(_links(members, texts, idf, similarity).where("a <> b").distinct(), "near-last-links")
    classes = through_table(_joined(roots, last), "near-classes")

    # Back to documents, through the node: hot nodes (many exact copies) are split.
    of_class = splittable_join(
        signed.select("key", "node").where("node is not null"), classes.select("node", "root"), ["node"], "left"
    ).withColumn("root", F.coalesce("root", "node"))
    per_root = of_class.groupBy("root").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # The document that stays: the smallest key, and of rows that repeat it the one of the smallest node.
    stays = splittable_join(of_class, per_root, ["root"], "inner").withColumn("_is", F.col("key").eqNullSafe(F.col("class_id")))
    keeper = stays.where("_is").groupBy("root").agg(F.min("node").alias("_node"))
    grouped = of_class.groupBy("root", "node", "key").agg(F.count(F.lit(1)).alias("_rows"))
    told = splittable_join(grouped, per_root.join(keeper, "root"), ["root"], "inner").withColumn(
        "_place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))
    )
    kept = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_node")) & (F.col("_place") == 1)
    alone = signed.where("node is null").select(
        F.col("key").alias(key), "node", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return told.select(F.col("key").alias(key), "node", "class_id", "class_size", kept.alias("kept")).unionAll(alone)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per class."""
    stay = near_classes(docs, key, text, **options).where("kept and node is not null")
    stay = stay.select(F.col(key).alias("_key"), F.col("node").alias("_node"))
    rows = docs.select(
        whole_row(docs).alias("_row"),
        row_hash(docs).alias("_hash"),
        F.col(key).cast("long").alias("_key"),
        word_digest(F.col(text)).alias("_node"),
    )
    same = F.col("r._key").eqNullSafe(F.col("s._key")) & (F.col("r._node") == F.col("s._node"))
    joined = rows.alias("r").join(stay.alias("s"), same, "left_semi")
    first = F.row_number().over(Window.partitionBy("_key", "_node").orderBy("_hash"))
    one = joined.withColumn("_first", first).where("_first = 1").select("_row.*")
    return one.unionAll(rows.where("_node is null").select("_row.*"))


def query(spark, sf_dir):
    return near_classes(read_table(spark, sf_dir, "documents")).drop("node")
