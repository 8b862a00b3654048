"""A quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole text with a stride of STRIDE. A filter is a table of one weight per
place and byte value, that is, a convolution over one-hot bytes, so applying it is WIDTH table look-ups. Positions are
pooled by maximum within segments of SEGMENT bytes, and two adjacent segments make a chunk, so chunks of
2 * SEGMENT bytes overlap by half and cover the text to its last byte. Chunks are combined by mean and by maximum;
with the logarithm of the length they go through one hidden layer to a probability. (Where the mean equals
the maximum in a long text, its chunks are all alike: that is how repetition shows.)

Only bytes of the text are input; labels, language, source and ids are not.

Fitting: Adam on the log loss, on the driver, over a bounded sample: the ``most_rows`` labelled rows of at most
``most_bytes`` bytes with the smallest hash, so at most most_rows * most_bytes bytes and usually a few MB.
Gradients reach only the position that won each maximum. Scoring covers every whole text in tasks.

Defined results: null and empty texts are scored as one segment of padding. With no labelled rows, or
one class only, the network stays near the prior. Repeated rows are scored each; a key labelled twice
counts twice in fitting. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.llm.common import crc_mod, prepare, read_table

WIDTH, STRIDE, SEGMENT = 8, 4, 512
FILTERS, HIDDEN = 24, 16
MOST_ROWS, MOST_BYTES = 6000, 1 << 16
EPOCHS, BATCH, RATE = 14, 48, 0.01
THRESHOLD = 0.3
FOLDS = 5

_PIECE = 1 << 20
_PER_SEGMENT = SEGMENT // STRIDE
_NEVER = np.float32(-1e9)


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    w1: np.ndarray  # (2 * FILTERS + 1, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray  # (HIDDEN,)
    b2: np.ndarray  # ()

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.w1, self.b1, self.w2, self.b2]


def new_net(seed: int, prior: float) -> Net:
    draw = np.random.default_rng(seed)
    n = 2 * FILTERS + 1
    f32 = np.float32
    return Net(
        draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f32),
        np.full(FILTERS, -1.0, f32),
        draw.normal(0, 1 / np.sqrt(n), (n, HIDDEN)).astype(f32),
        np.zeros(HIDDEN, f32),
        draw.normal(0, 0.3, HIDDEN).astype(f32),
        np.array(np.log(prior / (1 - prior)), f32),
    )


@dataclass
class Layout:
    """Texts laid out in whole segments, each followed by at least WIDTH zero bytes."""

    data: np.ndarray  # bytes, WIDTH more than the segments have
    used: np.ndarray  # bool per position: it starts inside a text
    first: np.ndarray  # first segment of each text
    count: np.ndarray  # segments of each text that hold bytes, at least 1
    length: np.ndarray


def lay_out(texts: list[bytes]) -> Layout:
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    room = -(-(length + WIDTH) // SEGMENT)
    first = np.cumsum(room) - room
    data = np.zeros(int(room.sum()) * SEGMENT + WIDTH, np.uint8)
    used = np.zeros(int(room.sum()) * _PER_SEGMENT, bool)
    for text, at, n in zip(texts, first.tolist(), length.tolist()):
        data[at * SEGMENT : at * SEGMENT + n] = np.frombuffer(text, np.uint8)
        used[at * _PER_SEGMENT : at * _PER_SEGMENT + max(1, -(-n // STRIDE))] = True
    return Layout(data, used, first, np.maximum(1, -(-length // SEGMENT)), length)


def convolve(net: Net, laid: Layout, start: int, stop: int) -> np.ndarray:
    """Filter responses at every position of segments start..stop: (segments, positions, FILTERS)."""
    n = (stop - start) * _PER_SEGMENT
    out, step = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
    base = start * SEGMENT
    for i in range(WIDTH):
        index = laid.data[base + i : base + i + n * STRIDE : STRIDE]
        if i == 0:
            np.take(net.tables[i], index, axis=0, out=out, mode="clip")
        else:
            np.take(net.tables[i], index, axis=0, out=step, mode="clip")
            out += step
    out[~laid.used[start * _PER_SEGMENT : stop * _PER_SEGMENT]] = _NEVER
    return out.reshape(stop - start, _PER_SEGMENT, FILTERS)


def pooled(net: Net, laid: Layout, winners: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(laid.used) // _PER_SEGMENT
    best = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int64) if winners else None
    for start in range(0, n, 64):
        stop = min(n, start + 64)
        response = convolve(net, laid, start, stop)
        if winners:
            where[start:stop] = response.argmax(1)
        best[start:stop] = response.max(1)
    return best, where


def chunked(best: np.ndarray, laid: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of the overlapping chunks, the segment each came from, and the first chunk of each text."""
    chunks = np.maximum(1, laid.count - 1)
    first = np.cumsum(chunks) - chunks
    left = np.repeat(laid.first - first, chunks) + np.arange(int(chunks.sum()))
    right = left + np.repeat(laid.count > 1, chunks)
    from_right = best[right] > best[left]
    segment = np.where(from_right, right[:, None], left[:, None])
    return np.maximum(best[left], best[right]), segment, first


def forward(net: Net, laid: Layout, winners: bool = False) -> dict:
    best, where = pooled(net, laid, winners)
    value, segment, first = chunked(best, laid)
    active = np.tanh(value + net.bias)
    chunks = np.diff(np.append(first, len(value)))
    mean = np.add.reduceat(active, first, axis=0) / chunks[:, None].astype(np.float32)
    top = np.maximum.reduceat(active, first, axis=0)
    size = (np.log1p(laid.length) / 8 - 1).astype(np.float32)[:, None]
    x = np.concatenate([mean, top, size], axis=1)
    h = np.tanh(x @ net.w1 + net.b1)
    z = h @ net.w2 + net.b2
    return {"where": where, "segment": segment, "first": first, "chunks": chunks, "active": active, "top": top, "x": x, "h": h, "z": z}


def gradients(net: Net, laid: Layout, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    f = forward(net, laid, winners=True)
    n = len(y)
    p = 1 / (1 + np.exp(-np.clip(f["z"], -30, 30)))
    dz = ((p - y) / n).astype(np.float32)
    dh = np.outer(dz, net.w2) * (1 - f["h"] ** 2)
    dx = dh @ net.w1.T
    owner = np.repeat(np.arange(n), f["chunks"])
    d_active = (dx[:, :FILTERS] / f["chunks"][:, None])[owner]
    is_top = f["active"] == f["top"][owner]
    ties = np.add.reduceat(is_top.astype(np.float32), f["first"], axis=0)
    d_active += np.where(is_top, (dx[:, FILTERS : 2 * FILTERS] / ties)[owner], 0)
    d_value = d_active * (1 - f["active"] ** 2)
    # Only the winning position of the winning segment has a gradient.
    filters = np.broadcast_to(np.arange(FILTERS), f["segment"].shape)
    position = f["segment"] * SEGMENT + f["where"][f["segment"], filters] * STRIDE
    d_tables = np.empty_like(net.tables)
    weights = d_value.ravel().astype(np.float64)
    for i in range(WIDTH):
        cell = laid.data[position + i].astype(np.int64) * FILTERS + filters
        d_tables[i] = np.bincount(cell.ravel(), weights, 256 * FILTERS).reshape(256, FILTERS)
    loss = float(np.mean(np.logaddexp(0, f["z"]) - y * f["z"]))
    return [d_tables, d_value.sum(0), f["x"].T @ dh, dh.sum(0), f["h"].T @ dz, dz.sum()], loss


def fit(texts: list[bytes], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Net:
    y = np.array(labels, np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    net = new_net(seed, prior)
    if len(y) == 0:
        return net
    draw = np.random.default_rng(seed)
    means = [np.zeros_like(p, dtype=np.float32) for p in net.parts()]
    squares = [np.zeros_like(p, dtype=np.float32) for p in net.parts()]
    # Few rows get more passes, so that every fit takes enough steps.
    epochs = max(epochs, -(-400 * BATCH // len(y)) if len(y) < 400 * BATCH // epochs else epochs)
    steps, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for start in range(0, len(y), BATCH):
            some = order[start : start + BATCH]
            grads, _ = gradients(net, lay_out([texts[i] for i in some]), y[some])
            steps += 1
            rate = RATE * min(1.0, steps / 20) * (1 - steps / (total + 1)) ** 0.5
            for k, (part, g) in enumerate(zip(net.parts(), grads)):
                g = np.asarray(g, np.float32) + 1e-5 * part
                means[k] = 0.9 * means[k] + 0.1 * g
                squares[k] = 0.99 * squares[k] + 0.01 * g * g
                part -= rate * (means[k] / (1 - 0.9**steps)) / (np.sqrt(squares[k] / (1 - 0.99**steps)) + 1e-7)
    return net


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    z = forward(net, lay_out(texts))["z"].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[list[bytes], list[int]]:
    learn = labels.where((crc_mod(F.col("doc_id"), FOLDS) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_text")
    # The hash picks the keys first, so that only chosen texts are gathered.
    chosen = learn.join(docs.where(F.octet_length("text") <= most_bytes).select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(most_rows)
    rows = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", body).join(F.broadcast(chosen), "doc_id")
    table = rows.orderBy(F.md5(F.col("doc_id").cast("string")), F.md5("_text")).limit(most_rows).toArrow()
    return table.column("_text").to_pylist(), table.column("quality").to_pylist()


def score_documents(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    narrow = docs.select(F.col(key), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            start = size = 0
            texts: list[bytes] = []
            for i, text_ in enumerate(batch.column(1).cast(pa.binary())):
                texts.append(text_.as_py() or b"")
                size += len(texts[-1])
                if size >= _PIECE or i == batch.num_rows - 1:
                    scored = pa.array(scores(shared.value, texts))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), scored], names=[batch.schema.names[0], "score"])
                    start, size, texts = i + 1, 0, []

    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    net = fit(*training_rows(docs, read_table(spark, sf_dir, "labels")))
    return score_documents(docs, net).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
