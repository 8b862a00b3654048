"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size, between 0 and
2. The whole part is certain; the fraction is rounded by pivotal sampling on words: two documents
exchange mass so that their expected words together never change, until one of them is at 0 or 1.
What is left of a block is one document with a fraction; the next level of a reduction tree pairs those
residuals, until one per source remains, which is rounded at random. So a source misses its
target by less than that last document, and each document is copied with its own probability. Blocks are
worked off from the largest document to the smallest, so the last one is small; a document too large to be paired
exchanges mass with the whole rest of its block, and one without which (or with which) its source cannot come to its
target at all is taken (or left).

Blocks hold about ``block_rows`` documents of one source, dealt by a hash of the document and, where rows repeat doc_id and
size, of their number among those, so a source
owning a third of all rows is spread over as many tasks as it has blocks. The tree has
log(blocks) / log(block_rows) levels above that. All draws are functions of the seed, the
document and the block: reruns agree, whatever the number of partitions.

Sources are ranked in code point order, null last; one row per source meets in one task (a source list,
not documents).

Defined results: a null text has size 0 and a null source is a source of its own. Documents of
size 0 are taken 0 times. A source whose documents are all empty has target 0. Repeated rows are separate
documents. Null doc_ids are allowed. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmate.llm.common import read_table, row_hash, through_table, whole_row, word_count

#: Fixed values of the mix: weights by rank of the source, share of all words, most copies.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_ROWS = 4096
LARGE, ODD = 0.02, 3.0
#: Rows of equal document and size that one task numbers.
NUMBERED = 10_000


def number_repeats(sized: DataFrame) -> DataFrame:
    """The rows (_doc, source, size) with ``_repeat``, their number from 0 among equal rows.

    Equal rows collapse to a count before the shuffle; the count is dealt out in parts of NUMBERED, so no task holds or
    writes all rows of a hot key.
    """
    counted = sized.groupBy("_doc", "source", "size").agg(F.count(F.lit(1)).alias("_times"))
    parts = counted.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(NUMBERED).cast("long"))))
    parts = parts.repartition("_doc", "size", "_start")
    last = F.least(F.col("_start") + NUMBERED, F.col("_times")) - 1
    return parts.select("_doc", "source", "size", F.explode(F.sequence("_start", last)).alias("_repeat"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """(source, source_size, target): weights times one common level, but at most ``most`` source sizes.

    Handing the excess over the caps to the other sources by weight, again and again, ends where every
    source has min(cap, weight * level) and the sum is right; the level is found by sorting
    sources by cap / weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(everything) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_w", F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    whole = Window.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("_cap", cap)
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        # the level if all sources before this one are at their caps and none from here on
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_found", F.max(F.when(F.col("_fits"), F.col("_level"))).over(whole))
    )
    level = F.coalesce(F.col("_found") * F.col("_w"), F.col("_cap"))
    return levels.select("source", "source_size", F.least(level, "_cap").alias("target"))


def pivot(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> int:
    """Round ``shares`` in place, pair by pair; the index of the one left with a fraction, or -1.

    A pair moves along the line that keeps size[a] * share[a] + size[b] * share[b]; which of the two
    ends it goes to is drawn so that both expectations stay.
    """
    held = -1
    for i in range(len(sizes)):
        if not 0.0 < shares[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1.0 - shares[a]) * sizes[a], shares[b] * sizes[b])  # words that can go from b to a
        down = min(shares[a] * sizes[a], (1.0 - shares[b]) * sizes[b])
        moved = up if draws[i] * (up + down) < down else -down
        shares[a] += moved / sizes[a]
        shares[b] -= moved / sizes[b]
        for j in (a, b):
            if shares[j] < 1e-9:
                shares[j] = 0.0
            elif shares[j] > 1 - 1e-9:
                shares[j] = 1.0
        held = a if 0.0 < shares[a] < 1.0 else b if 0.0 < shares[b] < 1.0 else -1
    return held


def settle_large(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray, large: float = LARGE) -> None:
    """Decide, in place, the documents that are too large to be paired: those above ``large`` of the words that are
    still open after them and ODD times their mean. ``sizes`` descend.

    Such a document exchanges mass with all open documents behind it at once, in proportion to share * (1 - share),
    so that words and expectations stay. Where the others cannot take what its loss would free (or give what it
    needs) it has only one end at which the target is reached, and goes there; where it has none, it is left.
    """
    for i in range(len(sizes)):
        if not 0.0 < shares[i] < 1.0:
            continue
        rest = np.arange(i + 1, len(sizes))
        rest = rest[(shares[rest] > 0) & (shares[rest] < 1)]
        if len(rest) == 0 or sizes[i] < max(large * sizes[rest].sum(), ODD * sizes[rest].mean()):
            break
        weight = shares[rest] * (1 - shares[rest])
        step = weight / (sizes[rest] * weight).sum()
        taken = shares[rest] - sizes[i] * (1 - shares[i]) * step
        left = shares[rest] + sizes[i] * shares[i] * step
        can_take, can_leave = taken.min() >= 0, left.max() <= 1
        if not (can_take or can_leave):
            continue
        take = can_take and (not can_leave or draws[i] < shares[i])
        shares[rest] = np.where(weight > 0, taken if take else left, shares[rest])
        shares[i] = 1.0 if take else 0.0


def _round_block(last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what is left at the end is then about as small as the smallest ones.
        rows = rows.sort_values(["_size", "_order", "_doc"], ascending=[False, True, True], ignore_index=True)
        shares = rows["_share"].to_numpy(dtype=np.float64).copy()
        key = [seed, len(rows), int(rows["_order"].iloc[0]) & 0xFFFFFFFFFFFFFFFF]
        draws = np.random.default_rng(key).random(len(rows) + 1)
        settle_large(rows["_size"].to_numpy(dtype=np.float64), shares, np.random.default_rng([*key, 1]).random(len(rows)))
        held = pivot(rows["_size"].to_numpy(dtype=np.float64), shares, draws)
        if last and held >= 0:
            shares[held] = 1.0 if draws[-1] < shares[held] else 0.0
        return rows.assign(_share=shares, _open=(shares > 0) & (shares < 1))

    return run


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights=WEIGHTS,
        share=SHARE, most=MOST_COPIES, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """One row per document: key, size, source_size, target (both its source's), copies, taken."""
    sized = through_table(
        docs.select(F.col(key).alias("_doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes"
    )
    targets = through_table(source_targets(sized, weights, share, most), "mix-targets")
    counts = sized.where("size > 0").groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    most_rows = counts.agg(F.max("_n")).first()[0] or 0
    # Joined by source: one row a source on the right, and hot sources are split by adaptive execution.
    plan = targets.join(counts, targets["source"].eqNullSafe(counts["source"]), "left").select(
        targets["source"].alias("_source"), "source_size", "target", "_n"
    )
    spread = F.pmod(F.xxhash64("_doc", "size", "_repeat"), F.lit(64))
    plan = plan.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = number_repeats(sized).withColumn("_part", spread).alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p._source")) & (F.col("d._part") == F.col("p._part"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select(
        "_doc", F.col("size").alias("_size"), "_source", "source_size", "target",
        F.when(F.col("size") > 0, F.least(F.floor(rate), F.lit(most)).cast("int")).otherwise(0).alias("_whole"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("_share"),
        F.xxhash64(F.lit(seed), "_doc", "size", "_repeat").alias("_order"),
        F.ceil(F.col("_n") / F.lit(block_rows)).alias("_blocks"),
    ).withColumn("_block", F.pmod(F.col("_order"), F.greatest(F.coalesce("_blocks", F.lit(1)), F.lit(1))))
    columns = ["_doc", "_size", "_source", "source_size", "target", "_whole", "_share", "_order", "_blocks", "_block"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*columns).dtypes)
    done, level, blocks = [rows.where("_share <= 0 or _share >= 1").select(*columns)], 0, math.ceil(most_rows / block_rows)
    opened = rows.where("_share > 0 and _share < 1").select(*columns)
    while True:
        last = blocks <= 1
        rounded = opened.groupBy("_source", "_block").applyInPandas(_round_block(last, seed + level), f"{schema}, `_open` boolean")
        rounded = through_table(rounded, f"mix-level-{level}")
        done.append(rounded.where("not _open").select(*columns))
        if last:
            break
        blocks, level = math.ceil(blocks / block_rows), level + 1
        opened = rounded.where("_open").withColumn("_blocks", F.ceil(F.col("_blocks") / F.lit(block_rows)))
        opened = opened.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "_order"), F.col("_blocks"))).select(*columns)
    copies = (F.col("_whole") + F.round("_share").cast("int")).alias("copies")
    return reduce(DataFrame.unionAll, done).select(
        F.col("_doc").alias(key), F.col("_size").alias("size"), "source_size", "target", copies,
        (F.col("_size") * copies).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    decided = mix(docs, key, **options).where("copies > 0")
    # Rows that repeat a key are matched by their place among the rows of that key.
    place = Window.partitionBy("_key", "_words").orderBy("_sort")
    rows = docs.select(
        whole_row(docs).alias("_row"),
        row_hash(docs).alias("_sort"),
        F.col(key).alias("_key"),
        word_count(F.col(options.get("text", "text"))).alias("_words"),
    )
    rows = rows.withColumn("_place", F.row_number().over(place))
    chosen = decided.select(F.col(key).alias("_key"), F.col("size").alias("_words"), F.col("copies").alias("_sort"))
    chosen = chosen.withColumn("_place", F.row_number().over(place))
    same = (F.col("r._key").eqNullSafe(F.col("c._key"))) & (F.col("r._words") == F.col("c._words")) & (F.col("r._place") == F.col("c._place"))
    joined = rows.alias("r").join(chosen.alias("c"), same).select("r._row", F.col("c._sort").alias("_copies"))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def query(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents"))
