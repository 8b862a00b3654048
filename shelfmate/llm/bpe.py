"""Byte-level BPE encoding and decoding by a rank file.

Pre-tokens come from the tokenizer's pattern. The distinct ones of a piece of text are resolved in two tiers:

1. a minimal perfect hash over the vocabulary (one slot per entry, displacements per bucket) answers all whole
   pre-tokens that are entries themselves, in a few numpy operations;
2. the others are merged: adjacent parts stand in a linked list over the bytes, a heap gives the pair of lowest
   rank, leftmost first, until no pair is an entry. n bytes take O(n log n), so a run of 100,000 letters is no problem.

The rank file (under 1 MB) is read by the driver and broadcast. Texts are worked off in pieces of
about PIECE characters at a time, whole texts always, so memory is bounded by a piece or the longest text.

Defined results: a null text encodes as an empty list, like an empty one; a null list decodes to null.
Extra columns are kept as they are unless they have the name of the output, which is replaced. An id outside
the vocabulary is an error.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.llm.common import prepare, read_table, through_table


PIECE = 1 << 21
#: Merged pre-tokens remembered from one piece of text to the next.
REMEMBERED = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by id. Ids must run from 0 without gaps."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                entry, rank = line.split()
                ranks[int(rank)] = base64.b64decode(entry)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: n keys, n slots. Keys fall into buckets of about four; a bucket's displacement is the
    first one that sends all its keys to free slots; buckets of one key store the slot itself, as -slot - 1."""

    TRIES = np.arange(1, 257, dtype=np.uint64)

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys repeat")
        self.size, self.n_buckets = n, max(1, n // 4)
        self.displacement = np.zeros(self.n_buckets, np.int64)
        self.entry = np.zeros(n, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        sizes = np.diff(first)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[first[b] : first[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                rest = np.flatnonzero(free)
                singles = [order[first[s]] for s in np.flatnonzero(sizes == 1)]
                self.displacement[np.flatnonzero(sizes == 1)] = -rest[: len(singles)] - 1
                self.entry[rest[: len(singles)]] = singles
                break
            base = 0
            while True:
                tries = self.TRIES + np.uint64(base)
                slots = self._slot(hashes[members][None, :], tries[:, None])
                fits = free[slots].all(1)
                ordered = np.sort(slots, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if fits.any():
                    won = int(np.argmax(fits))
                    self.displacement[b] = int(tries[won])
                    free[slots[won]] = False
                    self.entry[slots[won]] = members
                    break
                base += len(self.TRIES)

    def _bucket(self, hashes):
        return ((hashes >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64)

    def _slot(self, hashes, displacement):
        return (_mix(hashes ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.size)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The only entry each key can be; the caller compares."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        moved = self.displacement[self._bucket(hashes)]
        slots = self._slot(hashes, np.maximum(moved, 0).astype(np.uint64))
        return self.entry[np.where(moved < 0, -moved - 1, slots)]


_ID_BITS = 20


def pair_table(entries: list[bytes]) -> dict[int, int]:
    """The entry that two adjacent entries make together, by (left << _ID_BITS) | right."""
    ranks = {entry: i for i, entry in enumerate(entries)}
    pairs = {}
    for whole, entry in enumerate(entries):
        for cut in range(1, len(entry)):
            left, right = ranks.get(entry[:cut]), ranks.get(entry[cut:])
            if left is not None and right is not None:
                pairs[left << _ID_BITS | right] = whole
    return pairs


def merge(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token from the ids of its bytes. ``parts`` is used up.

    Each part links to the next and the previous one. The heap holds (rank, place of the left part); an entry counts
    only while it is still the rank of the pair at that place.
    """
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop, shift = pairs.get, heapq.heappush, heapq.heappop, n.bit_length()
    place = (1 << shift) - 1
    current = [get(left << _ID_BITS | right, -1) for left, right in zip(parts, parts[1:])]
    current.append(-1)
    heap = [rank << shift | i for i, rank in enumerate(current) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        left, rank = entry & place, entry >> shift
        if current[left] != rank:
            continue
        right = after[left]
        following = after[right]
        current[right] = -1
        parts[left], after[left] = rank, following
        grown = -1
        if following < n:
            before[following] = left
            grown = get(rank << _ID_BITS | parts[following], -1)
            if grown >= 0:
                push(heap, grown << shift | left)
        current[left] = grown
        if left:
            previous = before[left]
            grown = get(parts[previous] << _ID_BITS | rank, -1)
            current[previous] = grown
            if grown >= 0:
                push(heap, grown << shift | previous)
    ids, at = [], 0
    while at < n:
        ids.append(parts[at])
        at = after[at]
    return ids


class Encoder:
    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, regex.compile(pattern)
        ranks = {entry: i for i, entry in enumerate(entries)}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = pair_table(entries)
        self.hash = PerfectHash(entries)
        self.whole = [array("i", [i]).tobytes() for i in range(len(entries))]
        self.merged: dict[bytes, bytes] = {}  # ids of four bytes each

    def _resolve(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each token one after the other, and how many each has."""
        keys = [t.encode() for t in tokens]
        found = self.hash.lookup(keys).tolist()
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        single, whole, merged = self.byte_ids, self.whole, self.merged
        out = []
        for key, entry in zip(keys, found):
            if self.entries[entry] == key:
                out.append(whole[entry])
                continue
            parts = merged.get(key)
            if parts is None:
                parts = array("i", merge([single[b] for b in key], self.pairs)).tobytes()
                if len(key) <= 64:
                    merged[key] = parts
            out.append(parts)
        lengths = np.fromiter(map(len, out), np.int64, len(out)) >> 2
        return np.frombuffer(b"".join(out), np.int32), lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        split = [self.pattern.findall(text) for text in texts]
        distinct = list({token for tokens in split for token in tokens})
        place = {token: i for i, token in enumerate(distinct)}
        ids, lengths = self._resolve(distinct)
        starts = np.cumsum(lengths) - lengths
        out, counts = [], []
        for tokens in split:
            at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
            out.append(ids[_ranges(starts[at], lengths[at])])
            counts.append(len(out[-1]))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(counts, np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = stop = 0
    for stop, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, stop
            start, total = stop, 0
    if stop > start:
        yield start, stop


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + [column], names=[batch.schema.names[i] for i in kept] + [name]
    )


_ENCODERS: dict[str, Encoder] = {}


def _encoder(token: str, entries, pattern) -> Encoder:
    """One per worker process: it outlives the task, and so do the merges it remembers (at most REMEMBERED and a piece's)."""
    if token not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[token] = Encoder(entries.value, pattern)
    return _ENCODERS[token]


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([field for field in df.schema if field.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column of ids, array<int>."""
    prepare(df.sparkSession)
    entries = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    name = f"{path}|{pattern}"

    def run(batches):
        encoder = _encoder(name, entries, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for start, stop in _pieces(sizes, PIECE):
                piece = batch.slice(start, stop - start)
                ids, counts = encoder.encode([t or "" for t in texts.slice(start, stop - start).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield _with(piece, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))

    return df.mapInArrow(run, _schema_with(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with a column of bytes: the entries of each id, one after the other."""
    prepare(df.sparkSession)
    entries = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        vocabulary = np.frombuffer(b"".join(entries.value), np.uint8)
        sizes = np.fromiter(map(len, entries.value), np.int64, len(entries.value))
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            for start, stop in _pieces(lengths, PIECE // 4):
                piece, some = batch.slice(start, stop - start), lists.slice(start, stop - start)
                flat = some.flatten().to_numpy()
                if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
                    raise ValueError("id outside the vocabulary")
                data = vocabulary[_ranges(starts[flat], sizes[flat])]
                ends = np.concatenate([[0], np.cumsum(sizes[flat])])
                counts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy())])
                offsets = ends[counts].astype(np.int32)
                valid = some.is_valid().buffers()[1] if some.null_count else None
                column = pa.Array.from_buffers(
                    pa.binary(), len(some), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
                )
                yield _with(piece, out, column)

    return df.mapInArrow(run, _schema_with(df, out, T.BinaryType()))


def tokenized(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, stored: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes they decode to.

    ``stored``: the ids are written before they are decoded, so that a task has one Python worker at a time instead of two.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(docs.select("doc_id", "text"), path, pattern or public_tokenizers.PATTERN).drop("text")
    if stored:
        coded = through_table(coded, "bpe-ids")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(coded, path).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir):
    return tokenized(read_table(spark, sf_dir, "documents")).drop("ids")
