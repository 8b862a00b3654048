"""Tables that tasks read as they go, instead of a shuffle that sends each task its copy.

Where every task needs most rows of a table (vectors of the other side, rows of all users), a shuffle writes the table
once per task. Here it is packed into large rows, written once to the shared folder, and each task
streams the files, keeping what it needs. What is written follows the table; what is read is the table times the passes, and a
task holds one row group and the rows it picked, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.session import scratch_path, ship_package

# Bytes of a row group, which a reader holds whole, and of a packed row.
ROW_GROUP, PACKED_BYTES = 8 << 20, 1 << 20
VECTORS = "ids binary, vectors binary, gram binary"


def write_packed(df: DataFrame, name: str) -> str:
    """Write packed rows once; the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def packed_files(spark, path: str, schema: str) -> list[str]:
    """The files of a written folder, for ``read_packed``."""
    return sorted(spark.read.schema(schema).parquet(path).inputFiles())


def open_file(path: str):
    """A file of the shared folder, for reading inside a task."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_packed(files: list[str], columns: list[str]) -> Iterator[tuple]:
    """The columns of every packed row, one row at a time."""
    for path in files:
        with open_file(path) as source:
            table = pq.ParquetFile(source)
            for group in range(table.num_row_groups):
                for batch in table.read_row_group(group, columns=columns).select(columns).to_batches():
                    for i in range(batch.num_rows):
                        yield tuple(batch.column(c)[i] for c in range(len(columns)))


def numbers(value: pa.Scalar, kind) -> np.ndarray:
    """The numbers of a binary column, without a copy."""
    return np.frombuffer(value.as_buffer(), kind)


def flat_list(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False), offsets - offsets[0]


# --- vectors by index ---------------------------------------------------------------------


@dataclass(frozen=True)
class VectorStore:
    """Vectors (of ``kind``) by index in the shared folder, with their Gram matrix."""

    paths: list[str]
    files: list[str]
    width: int
    kind: str
    gram: np.ndarray

    def gather(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the indices ``wanted`` (sorted, distinct), zeros where there is none, and which there are.

        Vectors of an index that comes repeatedly are added up, as a join and a sum would.
        """
        out, there = np.zeros((len(wanted), self.width), self.kind), np.zeros(len(wanted), bool)
        for ids, vectors in read_packed(self.files, ["ids", "vectors"]):
            if ids.as_py() is None or not len(wanted):
                continue
            ids = numbers(ids, np.int64)
            at = np.searchsorted(wanted, ids)
            at[at == len(wanted)] = 0
            hit = wanted[at] == ids
            if hit.any():
                at, vectors = at[hit], numbers(vectors, self.kind).reshape(-1, self.width)[hit]
                if there[at].any() or len(np.unique(at)) < len(at):
                    np.add.at(out, at, vectors)
                else:
                    out[at] = vectors
                there[at] = True
        return out, there

    def frame(self, spark, name: str) -> DataFrame:
        """(name, vector) as a table."""
        width, kind = self.width, np.dtype(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, flat in zip(batch.column(0), batch.column(1)):
                    ids, flat = numbers(ids, np.int64), numbers(flat, kind)
                    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[name, "vector"])

        ship_package(spark)
        packed = spark.read.schema("ids binary, vectors binary").parquet(*self.paths).where("ids is not null")
        return packed.mapInArrow(run, f"{name} int, vector array<{'float' if kind == np.float32 else 'double'}>")


def packed_vectors(ids: np.ndarray, vectors: np.ndarray, kind: str) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
    """(ids, vectors, Gram matrix) in pieces of about PACKED_BYTES."""
    vectors = np.ascontiguousarray(vectors, kind)
    step = max(1, PACKED_BYTES // max(1, vectors.shape[1] * vectors.itemsize))
    for start in range(0, len(ids), step):
        part = vectors[start : start + step]
        wide = part.astype(np.float64)
        yield ids[start : start + step].astype(np.int64).tobytes(), part.tobytes(), wide.T @ wide


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat, _ = flat_list(batch.column(1), kind)
            ids = batch.column(0).to_numpy().astype(np.int64)
            for piece, vectors, gram in packed_vectors(ids, flat.reshape(len(ids), -1), kind):
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([vectors]), pa.array([gram.tobytes()])], names=["ids", "vectors", "gram"])

    return run


def store_vectors(df: DataFrame, key: str) -> VectorStore:
    """``df`` (key, vector) written once; rows without a key or a vector are left out."""
    ship_package(df.sparkSession)
    kind = "float32" if df.schema["vector"].dataType.simpleString() == "array<float>" else "float64"
    typed = df.where(F.col(key).isNotNull() & F.col("vector").isNotNull())
    typed = typed.select(F.col(key).cast("long").alias("idx"), F.col("vector").cast("array<float>" if kind == "float32" else "array<double>").alias("vector"))
    return open_store(df.sparkSession, [write_packed(typed.mapInArrow(_pack(kind), VECTORS), "vectors")], kind)


def add_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column(0):
            gram = numbers(value, np.float64)
            total = gram.copy() if total is None else total + gram
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["gram"])


def open_store(spark, paths: list[str], kind: str) -> VectorStore:
    """The store of written folders. To the driver come one f x f matrix per task and the names of the files."""
    grams = spark.read.schema(VECTORS).parquet(*paths).where("gram is not null").select("gram").mapInArrow(add_grams, "gram binary").collect()
    total = sum(np.frombuffer(r.gram) for r in grams) if grams else np.zeros(0)
    width = int(round(len(total) ** 0.5))
    return VectorStore(paths, [f for p in paths for f in packed_files(spark, p, VECTORS)], width, kind, total.reshape(width, width))
