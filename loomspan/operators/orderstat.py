"""Exact order statistics by refinement, and the bootstrap in one pass (AGG-17, AGG-23, WIN-10).

`at_ranks` counts equal values first, then narrows: each round deals the values of a group (later of the cells that hold a
wanted rank) to CELLS cells by their ends, finds the cells that hold the ranks from the cells' counts, and drops all others. What
is left after ROUNDS is ordered by a scan over ranges. Counts and wanted ranks are written between rounds. So a round is an aggregate that combines before it shuffles, and no group,
however large or lopsided, is ever on one task.

`bootstrap` draws resamples as weights: how many of the draws fall into a block of rows comes from halving ranges of
blocks (binomial counts, seeded by the range), how they spread inside from multinomial counts. Each task adds up its blocks' share of
every resample, so that `draws` rows a task are shuffled and rows are read once.

Null values don't count; NaN is larger than all numbers. Groups without values, and empty tables, give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.scan import _beside, _cells, _finite, ranged
from loomspan.operators.tables import written

CELLS, ROUNDS = 1024, 1
#: Rows of a block of the bootstrap, and resamples that a block weighs at a time.
BLOCK, AT_ONCE = 1024, 1024


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: Column) -> DataFrame:
    """by, rank, n, value: the values at the ranks (from 0) in the ascending order of each group's n values. ranks: an array made from `n`."""
    groups = by or ["_all"]
    counted = df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    counted = written(counted)  # every round reads it twice
    sizes = counted.groupBy(*groups).agg(F.sum("_c").alias("n"))
    wanted = sizes.select(*groups, "n", F.explode(F.array_distinct(ranks)).alias("rank")).where("rank >= 0 and rank < n").withColumn("_left", F.col("rank"))
    at: list[str] = []
    for level in range(ROUNDS):
        keys, cell = [*groups, *at], f"_cell{level}"
        ends = counted.groupBy(*keys).agg(F.min(_finite(F.col("_v"))).alias("_lo"), F.max(_finite(F.col("_v"))).alias("_hi"))
        counted = _beside(counted, ends, keys).withColumn(cell, _cells(F.col("_v"), F.col("_lo"), F.col("_hi"), F.lit(CELLS))).drop("_lo", "_hi")
        cells = counted.groupBy(*keys, cell).agg(F.sum("_c").alias("_m"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("_before", before)
        here = _same_as(wanted, cells, keys) & (F.col("_w._left") >= F.col("_c._before")) & (F.col("_w._left") < F.col("_c._before") + F.col("_c._m"))
        wanted = wanted.alias("_w").join(cells.alias("_c"), here).select("_w.*", F.col(f"_c.{cell}").alias(cell), F.col("_c._before").alias("_b"))
        wanted = written(wanted.withColumn("_left", F.col("_left") - F.col("_b")).drop("_b"))
        at.append(cell)
        # Only values of cells that hold a wanted rank go on.
        keep = wanted.select(*groups, *at).distinct().withColumn("_in", F.lit(True))
        counted = _beside(counted, keep, [*groups, *at]).where("_in").drop("_in")
        counted = written(counted) if level + 1 < ROUNDS else counted
    keys = [*groups, *at]
    placed = ranged(counted, keys, "_v").running(_upto=("sum", "_c")).rows()
    here = _same_as(wanted, placed, keys) & (F.col("_w._left") >= F.col("_c._upto") - F.col("_c._c")) & (F.col("_w._left") < F.col("_c._upto"))
    out = wanted.alias("_w").join(placed.alias("_c"), here)
    return out.select(*[F.col(f"_w.{c}").alias(c) for c in by], F.col("_w.rank").alias("rank"), F.col("_w.n").alias("n"), F.col("_c._v").alias("value"))


def _same_as(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for c in keys:
        out &= F.col(f"_w.{c}").eqNullSafe(F.col(f"_c.{c}"))
    return out


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """by, a column for each name: quantiles with linear interpolation between neighbours, exact."""
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*[f(place(p)).cast("long") for p in probabilities.values() for f in (F.floor, F.ceil)])
    found = at_ranks(df, by, value, ranks)
    held = found.groupBy(*by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def between(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when(low == high, a).otherwise(a + (b - a) * (place(p) - low))

    return held.select(*by, *[between(p).alias(name) for name, p in probabilities.items()])


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def drawn_into(block: int, blocks: int, n: int, draws: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """How many of the n draws of each resample fall into a block of rows; the blocks' counts add up to n."""
    rows = lambda lo, hi: min(hi * size, n) - lo * size
    lo, hi, counts = 0, blocks, np.full(draws, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _rng(seed, lo, hi).binomial(counts, rows(lo, mid) / rows(lo, hi))
        lo, hi, counts = (lo, mid, left) if block < mid else (mid, hi, counts - left)
    return counts


def bootstrap(df: DataFrame, key: str, value: str, draws: int = 10_000, seed: int = 0, size: int = BLOCK) -> DataFrame:
    """AGG-23: draw, mean: means of `draws` resamples (with replacement) of the rows' values. key: a number that orders the rows; size: rows of a block."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"))
    placed = ranged(rows, [], "_key", ["_key", "_value"]).running(_at=("count", None)).totals(_n=None).rows()
    dealt = placed.withColumn("_block", F.floor((F.col("_at") - 1) / F.lit(size))).repartition("_block").sortWithinPartitions("_block", "_at")
    schema = pa.schema([("draw", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])

    def weigh(batches):
        totals, held, now, n = np.zeros(draws), [], None, 0

        def add():
            x = np.array(held)
            into = drawn_into(now, -(-n // size), n, draws, seed, size)
            rng = _rng(seed, "rows", now)
            for a in range(0, draws, AT_ONCE):
                totals[a : a + AT_ONCE] += rng.multinomial(into[a : a + AT_ONCE], np.full(len(x), 1 / len(x))) @ x

        for rb in batches:
            for block, v, of in zip(*(rb.column(c).to_pylist() for c in ("_block", "_value", "_n")), strict=True):
                if block != now:
                    if held:
                        add()
                    now, held, n = block, [], of
                held.append(v)
        if held:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(totals), pa.array(np.full(draws, n))], schema=schema)

    sums = dealt.mapInArrow(weigh, "draw long, total double, n long")
    return sums.groupBy("draw").agg((F.sum("total") / F.first("n")).alias("mean"))
