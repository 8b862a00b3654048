"""Dense factor vectors: exact top-k scoring, Gram matrix and fold-in of new histories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmate.operators.packed import VectorStore, flat_list, numbers, packed_files, read_packed, store_vectors, write_packed
from shelfmate.session import cut_lineage, ship_package

# Vectors per block, rows of a block scored at a time inside a task, and candidates scored again in full.
FACTOR_BLOCK = 2048
SCORED_AT_ONCE = 1024
CHECKED_AT_ONCE = 1 << 16
SCORE_DIGITS = 9
# Tiles are written in bundles of about so many items. A task reads them for blocks of at most so many queries; where there are fewer,
# for at least LEAST_QUERIES, in at most SPREAD_QUERIES tasks.
BUNDLE, SPREAD = 16_384, 8
QUERY_BLOCK, LEAST_QUERIES, SPREAD_QUERIES = 8192, 64, 32
# At most so many directions and bands of norms; each band but the lowest holds half of what is above its lower end.
CELLS, BANDS = 64, 12
# Room for rounding in scores and angles.
SCORE_SLACK, ANGLE_SLACK = 1e-8, 1e-7

# Bytes of vectors that a task holds to add them up.
SUMMED_BYTES = 160 << 20

TILES = "tile int, ids binary, vectors binary"


def unit_length(df: DataFrame, column: str) -> DataFrame:
    """Scale an array column to length one; zero vectors are dropped."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    scaled = F.transform(column, lambda x: x.cast("double") / F.col("_norm"))
    return df.withColumn("_norm", norm).where(F.col("_norm") > 0).withColumn(column, scaled).drop("_norm")


@dataclass(frozen=True)
class ItemGroups:
    """Items by direction and length: what a bound on their scores needs to know of each group.

    A group is a cell (the items closest in angle to one of at most CELLS pivots) and a band of norms. There are at most
    CELLS * BANDS groups whatever the number of items, so this is small enough for the driver and for every task. A
    group of many items has several tiles, which share its bound.
    """

    pivots: np.ndarray  # unit vectors
    cuts: np.ndarray  # rising norms between bands
    cell: np.ndarray
    band: np.ndarray
    size: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    widest: np.ndarray  # largest angle between an item and its pivot
    tiles: np.ndarray
    block_size: int = FACTOR_BLOCK

    @property
    def first_tile(self) -> np.ndarray:
        return np.cumsum(self.tiles) - self.tiles

    def bundles(self, block_size: int) -> np.ndarray:
        """The bundle of every tile: neighbouring tiles, at least SPREAD bundles where there are enough items."""
        per_tile = np.repeat(self.size / self.tiles, self.tiles)
        most = max(block_size, min(BUNDLE, -(-int(self.size.sum()) // SPREAD)))
        return ((np.cumsum(per_tile) - per_tile) // most).astype(np.int32)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No item of group g scores more with query q than [q, g].

        The angle between them is at least that to the pivot less the group's widest.
        """
        norms = np.linalg.norm(queries, axis=1)
        cosines = queries @ self.pivots.T / np.where(norms > 0, norms, 1.0)[:, None]
        closest = np.cos(np.maximum(np.arccos(np.clip(cosines, -1, 1))[:, self.cell] - self.widest - ANGLE_SLACK, 0))
        return norms[:, None] * np.where(closest > 0, self.longest, self.shortest) * closest

    def first_visit(self, bounds: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Per query the groups of the highest bounds that together hold the number of items needed."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(out, order, before < needed[:, None], axis=1)
        return out


def _place_items(pivots: np.ndarray, cuts: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            matrix = np.stack(frame.vector.to_numpy()).astype(np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            cosines = matrix @ pivots.T / np.where(norms > 0, norms, 1.0)[:, None]
            cell = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            band = np.searchsorted(cuts, norms, side="right").astype(np.int32)
            yield frame.assign(cell=cell.astype(np.int32), band=band, norm=norms, angle=np.where(norms > 0, angle, 0.0))

    return run


def group_items(items: DataFrame, block_size: int = FACTOR_BLOCK) -> tuple[ItemGroups, DataFrame]:
    """The groups of ``items`` (item_idx, vector), and the items with their group's tile: (item_idx, vector, tile, bundle)."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    shares = [1 - 0.5**j for j in range(1, BANDS)]
    count, cuts = items.agg(F.count(F.lit(1)), F.percentile_approx(length, shares, 10_000)).first()
    many = max(1, min(CELLS, -(-count // (4 * block_size)))) if count > block_size else 1
    # Which items are pivots does not matter for the result; a hash makes it the same at every run.
    rows = items.where(length > 0).orderBy(F.xxhash64("item_idx"), "item_idx").limit(many).select("vector").collect()
    width = items.select(F.max(F.size("vector"))).first()[0] or 1
    pivots = np.array([r.vector for r in rows], dtype=np.float64) if rows else np.eye(1, width)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    cuts = np.unique(np.array(cuts or [], dtype=np.float64)) if count > block_size else np.array([])
    schema = "item_idx bigint, vector array<double>, cell int, band int, norm double, angle double"
    placed = cut_lineage(items.mapInPandas(_place_items(pivots, cuts), schema))
    found = placed.groupBy("cell", "band").agg(
        F.count(F.lit(1)).alias("size"), F.max("norm").alias("longest"), F.min("norm").alias("shortest"), F.max("angle").alias("widest")
    )
    table = found.orderBy("cell", "band").toPandas()  # at most CELLS * BANDS rows
    tiles = -(-table["size"].to_numpy() // block_size)
    columns = [table[c].to_numpy() for c in ("cell", "band", "size", "longest", "shortest", "widest")]
    groups = ItemGroups(pivots, cuts, *columns, tiles, block_size)
    tiled = [(n, int(b)) for n, b in enumerate(groups.bundles(block_size))]
    tiled = items.sparkSession.createDataFrame(tiled, "tile int, bundle int")  # a row per block_size items at most, and per group
    numbered = items.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in zip(groups.cell, groups.band, groups.first_tile, tiles)], "cell int, band int, _first int, _tiles int"
    )
    tile = (F.col("_first") + F.pmod(F.xxhash64("item_idx"), F.col("_tiles"))).cast("int")
    placed = placed.join(F.broadcast(numbered), ["cell", "band"]).select("item_idx", "vector", tile.alias("tile"))
    return groups, placed.join(F.broadcast(tiled), "tile").select("item_idx", "vector", "tile", "bundle")


def _pack_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, item_idx, vector) sorted by tile; one row per tile, or per batch it spans."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tile, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        flat, _ = flat_list(batch.column(2), np.float64)
        vectors = flat.reshape(len(ids), -1)
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(tile)) + 1):
            at = slice(part[0], part[-1] + 1)
            columns = [pa.array([int(tile[part[0]])], pa.int32()), pa.array([ids[at].astype(np.int64).tobytes()]), pa.array([vectors[at].tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "ids", "vectors"])


class _Best:
    """The best candidates so far of a block of queries, and the k-th score of each."""

    def __init__(self, rows: int, top_k: int):
        self.top_k, self.limit = top_k, max(1024, rows * top_k // 2)
        self.kth = np.full(rows, -np.inf)
        self.held, self.pending, self.size = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0

    def add(self, rows, ids, scores) -> None:
        self.pending.append((rows, ids, scores))
        self.size += len(rows)
        if self.size > self.limit:
            self.merge()

    def merge(self) -> None:
        rows, ids, scores = (np.concatenate(parts) for parts in zip(self.held, *self.pending))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.top_k
        self.held, self.pending, self.size = (rows[keep], ids[keep], scores[keep]), [], 0
        last = place == self.top_k - 1
        self.kth[rows[last]] = scores[last]


class _Block:
    """Queries of a task with what is excluded for them, scored tile by tile."""

    def __init__(self, vectors: np.ndarray, ban_row: np.ndarray, ban_item: np.ndarray, top_k: int):
        self.vectors, self.norms = vectors, np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / np.where(self.norms > 0, self.norms, 1.0)[:, None]).astype(np.float32)
        order = np.argsort(ban_item, kind="stable")
        self.ban_row, self.ban_item = ban_row[order], ban_item[order]
        self.best = _Best(len(vectors), top_k)

    def banned(self, ids: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``who``, place in ``ids``) of excluded pairs."""
        low, high = np.searchsorted(self.ban_item, ids, "left"), np.searchsorted(self.ban_item, ids, "right")
        # An item that comes repeatedly is left out once.
        n = np.where(np.append(True, ids[1:] != ids[:-1]), high - low, 0)
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row_of = np.full(len(self.vectors), -1)
        row_of[who] = np.arange(len(who))
        row, col = row_of[self.ban_row[at]], np.repeat(np.arange(len(ids)), n)
        return row[row >= 0], col[row >= 0]

    def score(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The items of one tile for the queries ``who``.

        Single precision tells which items can reach a query's k-th score so far, or the k best of the tile; only these are
        scored in full. Lengths are taken out first, so the error is below that of a sum of products of at most one.
        """
        fine = np.isfinite(vectors).all(axis=1)
        if not fine.all():
            ids, vectors = ids[fine], vectors[fine]
        if not len(ids):
            return
        longest = np.linalg.norm(vectors, axis=1).max()
        unit = (vectors / (longest if longest > 0 else 1.0)).astype(np.float32).T
        ban_row, ban_col = self.banned(ids, who)
        k, error = min(self.best.top_k, len(ids)), np.float32((vectors.shape[1] + 8) * 2.0**-23)
        for start in range(0, len(who), SCORED_AT_ONCE):
            rows = who[start : start + SCORED_AT_ONCE]
            scores = self.unit[rows] @ unit
            here = (ban_row >= start) & (ban_row < start + len(rows))
            scores[ban_row[here] - start, ban_col[here]] = -np.inf
            length = self.norms[rows] * longest
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(length > 0, (self.best.kth[rows] - SCORE_SLACK * (1 + np.abs(self.best.kth[rows]))) / length, -np.inf)
            least = (np.nan_to_num(least, nan=-np.inf, neginf=-np.inf) - 2 * error).astype(np.float32)
            fresh = np.flatnonzero(np.isneginf(self.best.kth[rows]))
            if len(fresh):
                part = scores if len(fresh) == len(rows) else scores[fresh]
                least[fresh] = np.partition(part, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * error
            row, col = np.divmod(np.flatnonzero(scores >= least[:, None]), len(ids))
            for at in range(0, len(row), CHECKED_AT_ONCE):
                r, c = row[at : at + CHECKED_AT_ONCE], col[at : at + CHECKED_AT_ONCE]
                there = ~np.isneginf(scores[r, c])
                r, c = r[there], c[there]
                full = np.round(np.einsum("ij,ij->i", self.vectors[rows[r]], vectors[c]), SCORE_DIGITS)
                there = np.isfinite(full)
                self.best.add(rows[r[there]], ids[c[there]], full[there])
        if self.best.pending and np.isneginf(self.best.kth[who]).any():
            self.best.merge()


def _sliced(function, *arrays: np.ndarray) -> np.ndarray:
    return np.concatenate([function(*[a[i : i + SCORED_AT_ONCE] for a in arrays]) for i in range(0, len(arrays[0]), SCORED_AT_ONCE)])


def _search(groups: ItemGroups, files: list[str], top_k: int, counted: bool):
    """Queries (query, vector, banned) in; their best items out. ``counted``: the number of visits too, beside no item."""
    group_of = np.repeat(np.arange(len(groups.size)), groups.tiles)

    def answer(table: pa.Table, wanted: int) -> Iterator[pa.RecordBatch]:
        if not len(groups.size):
            return
        flat, _ = flat_list(table.column("vector").chunk(0), np.float64)
        bans, offsets = flat_list(table.column("banned").chunk(0), np.int64)
        vectors, n_bans = flat.reshape(table.num_rows, -1), np.diff(offsets)
        block = _Block(vectors, np.repeat(np.arange(table.num_rows), n_bans), bans, top_k)
        fine = np.isfinite(block.norms)
        bounds = _sliced(groups.bounds, np.where(fine[:, None], vectors, 0.0))
        visit = _sliced(groups.first_visit, bounds, wanted + n_bans) & fine[:, None]
        visits = 0
        for first in (True, False):
            if not first:
                block.best.merge()
                least = block.best.kth - SCORE_SLACK * (1 + np.abs(np.where(np.isfinite(block.best.kth), block.best.kth, 0)))
                visit = ~visit & fine[:, None] & (bounds >= least[:, None])
            if not visit.any():
                continue
            for tile, ids, items in read_packed(files, ["tile", "ids", "vectors"]):
                group = group_of[tile.as_py()]
                who = np.flatnonzero(visit[:, group])
                if not first and len(who):
                    kth = block.best.kth[who]
                    who = who[bounds[who, group] >= kth - SCORE_SLACK * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))]
                if len(who):
                    ids = numbers(ids, np.int64)
                    visits += len(who)
                    block.score(who, ids, numbers(items, np.float64).reshape(len(ids), -1))
        block.best.merge()
        rows, ids, scores = block.best.held
        query = table.column("query").combine_chunks().take(pa.array(rows))
        query = query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query
        yield pa.RecordBatch.from_arrays([query, pa.array(ids), pa.array(scores), pa.nulls(len(ids), pa.int64())], names=["query", "item_idx", "score", "visits"])
        if counted:
            columns = [pa.nulls(1, query.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([visits])]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "item_idx", "score", "visits"])

    def run(batches: Iterator[pa.RecordBatch], wanted: int = 8 * top_k) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, QUERY_BLOCK - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == QUERY_BLOCK:
                    yield from answer(pa.Table.from_batches(held).combine_chunks(), wanted + groups.block_size)
                    held, rows = [], 0
        if held:
            yield from answer(pa.Table.from_batches(held).combine_chunks(), wanted + groups.block_size)

    return run


def top_items(
    queries: DataFrame,
    items: DataFrame,
    top_k: int,
    exclude: DataFrame | None = None,
    block_size: int = FACTOR_BLOCK,
    report: dict | None = None,
) -> DataFrame:
    """The best items of every query vector by inner product.

    ``queries`` (query, vector), ``items`` (item_idx, vector), ``exclude`` (query, item_idx)
    pairs that must not be returned. Result (query, rank, item_idx, score).

    The answer is exact without scoring all pairs. Items are grouped by direction and norm (ItemGroups). A first visit
    scores each query against the groups of its highest bounds, as many as hold a tile's worth of items beside the query's exclusions;
    its k-th score is a threshold, and the second visit goes only to groups whose bound reaches it. How much that leaves out
    depends on the vectors: lengths and directions that differ much prune much, unit vectors in all directions nothing.

    No item vector is shuffled: tiles of at most about ``block_size`` items are written once, and every block of queries (QUERY_BLOCK
    at most) reads them in its task, once per visit. A query travels once, with all that is excluded for it. ``report``, if given,
    gets the numbers of (query, tile) pairs: ``all`` and ``visited``.
    """
    spark = items.sparkSession
    ship_package(spark)
    typed = queries.where(F.col("vector").isNotNull()).select("query", F.col("vector").cast("array<double>").alias("vector"))
    groups, placed = group_items(items.select(F.col("item_idx").cast("long"), F.col("vector").cast("array<double>").alias("vector")), block_size)
    tiles = placed.repartition("bundle").sortWithinPartitions("tile", "item_idx").select("tile", "item_idx", "vector")
    files = packed_files(spark, write_packed(tiles.mapInArrow(_pack_tiles, TILES), "tiles"), TILES)
    none = F.array().cast("array<bigint>")
    if exclude is not None:
        banned = exclude.groupBy("query").agg(F.collect_set(F.col("item_idx").cast("long")).alias("banned"))
        asked = typed.join(banned, "query", "left").select("query", "vector", F.coalesce("banned", none).alias("banned"))
    else:
        asked = typed.select("query", "vector", none.alias("banned"))
    asked = cut_lineage(asked)
    n_queries = asked.count()
    tasks = max(1, -(-n_queries // QUERY_BLOCK), min(SPREAD_QUERIES, -(-n_queries // LEAST_QUERIES)))
    query_type = typed.schema["query"].dataType.simpleString()
    search = _search(groups, files, top_k, report is not None)
    found = asked.repartition(tasks).mapInArrow(search, f"query {query_type}, item_idx long, score double, visits long")
    if report is not None:
        found = cut_lineage(found)
        report.update(all=n_queries * int(groups.tiles.sum()), visited=found.agg(F.sum("visits")).first()[0] or 0)
    best = W.partitionBy("query").orderBy(F.desc("score"), "item_idx")
    return (
        found.where(F.col("item_idx").isNotNull())
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
        .select("query", "rank", F.col("item_idx").cast("int").alias("item_idx"), "score")
    )


def similar_items(items: DataFrame, top_k: int, seeds: DataFrame | None = None, **options) -> DataFrame:
    """Cosine neighbours in factor space, the item itself removed.

    ``items`` (item_idx, vector); ``seeds`` (item_idx) restricts the queries.
    """
    units = unit_length(items.select("item_idx", "vector"), "vector")
    queries = units if seeds is None else units.join(seeds.select("item_idx").distinct(), "item_idx", "left_semi")
    queries = queries.withColumnRenamed("item_idx", "query")
    itself = queries.select("query", F.col("query").alias("item_idx"))
    return top_items(queries, units, top_k, exclude=itself, **options)


def gram_matrix(items: DataFrame, column: str = "vector") -> DataFrame:
    """(i, j, value) of Y'Y. Each task adds up its own f x f matrix; f is the number of factors."""
    ship_package(items.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = batch.column(0)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            block = flat.reshape(batch.num_rows, -1)
            total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i.ravel().astype(np.int32)),
                    pa.array(j.ravel().astype(np.int32)),
                    pa.array(total.ravel()),
                ],
                names=["i", "j", "value"],
            )

    parts = items.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram_array(items: DataFrame, column: str = "vector") -> np.ndarray:
    """The Gram matrix on the driver: f * f numbers, independent of the number of items."""
    cells = gram_matrix(items, column).toPandas()
    size = int(cells.i.max()) + 1
    out = np.zeros((size, size))
    out[cells.i.to_numpy(), cells.j.to_numpy()] = cells.value.to_numpy()
    return out


def sum_vectors(df: DataFrame, by: str, column: str = "vector") -> DataFrame:
    """Element-wise sum of array columns per group, partly summed before the shuffle."""
    as_vector = array_to_vector(F.col(column).cast("array<double>"))
    return df.groupBy(by).agg(vector_to_array(Summarizer.sum(as_vector)).alias(column))


def _sum_listed(items: VectorStore):
    """(query, item indices, counts) in; the summed vectors of each query's known items out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, SUMMED_BYTES // max(1, items.width * np.dtype(items.kind).itemsize))
        held, cells = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            (ids, offsets), (n, _) = (flat_list(table.column(c).chunk(0), np.int64) for c in ("ids", "n"))
            wanted, at = np.unique(ids, return_inverse=True)
            vectors, there = items.gather(wanted)
            query = table.column("query").chunk(0)
            start = 0
            while start < len(query):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHECKED_AT_ONCE, side="right")) - 1)
                cell = slice(offsets[start], offsets[stop])
                first = offsets[start:stop] - offsets[start]
                known = np.add.reduceat(there[at[cell]].astype(np.int64), first) > 0
                sums = np.add.reduceat(vectors[at[cell]].astype(np.float64) * n[cell][:, None], first)[known]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * items.width), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([query.slice(start, stop - start).filter(pa.array(known)), lists], names=["query", "vector"])
                start = stop

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                cells += len(batch.column("ids").flatten())
                if cells >= most:
                    yield from flush()
                    held, cells = [], 0
        if held and items.width:
            yield from flush()

    return run


def sum_of_items(histories: DataFrame, items: DataFrame) -> DataFrame:
    """(query, vector): the sum of the vectors of ``items`` (item_idx, vector) over the rows (query, item_idx) of a history.

    Repeated rows count repeatedly; items without a vector are ignored, and so are histories of such items only. No vector is shuffled:
    a query's items travel as a list, and tasks pick the vectors from a written copy.
    """
    known = histories.where(F.col("item_idx").isNotNull())
    counted = known.groupBy("query", F.col("item_idx").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy("query").agg(F.collect_list(F.struct("id", "n")).alias("l")).select("query", F.col("l.id").alias("ids"), F.col("l.n").alias("n"))
    query_type = histories.schema["query"].dataType.simpleString()
    return listed.mapInArrow(_sum_listed(store_vectors(items, "item_idx")), f"query {query_type}, vector array<double>")


def ridge_factor(gram: np.ndarray, regularization: float) -> np.ndarray:
    """Lower Cholesky factor of ``Y'Y + reg I``: made once per model and stored with it."""
    return np.linalg.cholesky(gram + regularization * np.eye(len(gram)))


def fold_in(
    histories: DataFrame, items: DataFrame, regularization: float, gram: np.ndarray | None = None, factor: np.ndarray | None = None
) -> DataFrame:
    """User vectors for histories the model has not seen: (query, vector).

    Every history item counts with weight one, so the normal equation is
    ``(Y'Y + reg I) x = sum of the item vectors``; repeated items count repeatedly and
    items without factors are ignored. ``factor``, the model's ``ridge_factor``, saves the pass over all items; tasks solve
    with it batch by batch.
    """
    if factor is None:
        factor = ridge_factor(gram_array(items) if gram is None else gram, regularization)
    return solve_with(sum_of_items(histories, items), "vector", factor)


def solve_with(df: DataFrame, column: str, factor: np.ndarray) -> DataFrame:
    """Solve ``L L' x = b`` for the vectors b of a column, one Arrow batch at a time."""

    def solve(vectors: np.ndarray) -> np.ndarray:
        return np.linalg.solve(factor.T, np.linalg.solve(factor, vectors.T)).T

    return map_vectors(df, column, solve)


def times_matrix(df: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """Multiply a vector column by a small symmetric matrix, one Arrow batch at a time."""
    return map_vectors(df, column, lambda vectors: vectors @ matrix)


def map_vectors(df: DataFrame, column: str, function) -> DataFrame:
    """Replace a vector column by a function of its (rows x f) batches."""
    ship_package(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame = frame.assign(**{column: list(function(np.stack(frame[column].to_numpy())))})
            yield frame

    typed = df.withColumn(column, F.col(column).cast("array<double>"))
    return typed.mapInPandas(run, typed.schema)
