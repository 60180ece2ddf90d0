"""Mixing sources to target weights, in blocks of words.

Each source's documents, in an order by hash, are one stream of words cut into blocks of `block` words. The
mix is a row of slots dealt over output shards. For each shard the counts of the sources are drawn: multinomial
counts, conditioned on what the mix holds of each source in all (free draws would run past the cap
of two copies), which makes them multivariate hypergeometric. The k-th slot of a source then takes block
permutation(k), with another pseudorandom permutation of the source's blocks for each pass; inside its shard a slot
stands at a pseudorandom place. The documents' pieces join the slots by block index and are written by shard:
what a document gives to the mix is read from those shards.

Null texts have size 0 and take 0; a null source is a source of its own and stands last; repeated rows are
rows of their own; sizes of any length work, since a document spans as many blocks as it needs. An empty
table gives no rows. All draws are seeded, so reruns agree. The driver holds a row per source, and refuses more
than MAX_SOURCES.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
BLOCK = 32
#: Slots in an output shard.
SHARD = 8192
#: Sources that the driver plans for at most: a row each.
MAX_SOURCES = 1_000_000
#: Documents whose offsets one task adds up, and buckets of them in a group.
BUCKET_DOCS = 2048
GROUP_BUCKETS = 4096
#: From so many slots on numpy draws no hypergeometric counts; `hypergeometric` then draws the same distribution.
NUMPY_SLOTS = 1_000_000_000
#: MB of the input's files whose share of the mix one task writes.
SHARD_MB = 16
SEED = 20


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words wanted of each source: `share` of all by weight; what is over cap * size goes to the others by weight."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def _stirling(n: float) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x * log(x / mean) + mean - x, without cancellation where both are close."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * k + 1)
            if new == total:
                return total
            total, k = new, k + 1
    return x * math.log(x / mean) + mean - x if x else mean


def binomial_log(y: int, n: int, p: float) -> float:
    """log of the binomial probability, precise for counts of any size (saddle-point form)."""
    if y < 0 or y > n:
        return -math.inf
    if y == 0 or y == n:
        return n * (math.log1p(-p) if y == 0 else math.log(p))
    return _stirling(n) - _stirling(y) - _stirling(n - y) - _deviance(y, n * p) - _deviance(n - y, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * y * (n - y)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn of good + bad, of any size.

    Two binomial counts with one probability, given that they add up to n, are hypergeometric: the count of the smaller
    side is proposed, and accepted as probable as the other side's rest is.
    """
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if n == 0 or good == 0:
        return 0
    if n == good + bad:
        return good
    p = n / (good + bad)
    top = binomial_log(min(int((bad + 1) * p), bad), bad, p)
    while True:
        x = int(rng.binomial(good, p))
        if math.log(1 - rng.random()) <= binomial_log(n - x, bad, p) - top:
            return x


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots each source gets, of `counts` in all: multivariate hypergeometric at every size."""
    if counts.sum() < NUMPY_SLOTS:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, left, rest = np.zeros(len(counts), np.int64), n, int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, left)
        left -= int(out[i])
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") | 1) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            z = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * (k | np.uint64(1))
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def plan(sizes: list[int], wanted: list[float], block: int, cap: int = CAP) -> tuple[list[int], list[int]]:
    """(blocks, slots) of each source; no source has more slots than `cap` passes over its blocks."""
    blocks = [-(-s // block) for s in sizes]
    slots = [min(cap * b, round(w * b / s)) if s else 0 for s, b, w in zip(sizes, blocks, wanted, strict=True)]
    return blocks, slots


def draw_slots(spark: SparkSession, blocks: list[int], slots: list[int], seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """One row per slot of the mix: shard, slot in it, source number, pass over the source, block."""
    total = sum(slots)
    shards = -(-total // shard)
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_no", pa.int32()), ("pass", pa.int32()), ("block", pa.int64())])
    key = lambda *of: int.from_bytes(hashlib.sha256("/".join(map(str, (seed, *of))).encode()).digest()[:6], "big")

    def of_shard(s: int, drawn: dict) -> tuple[np.ndarray, np.ndarray]:
        """(slots, first slot) of each source in a shard: the halves of a range of shards are drawn from the range's own counts."""
        lo, hi, counts, first = 0, shards, np.array(slots, np.int64), np.zeros(len(slots), np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in drawn:
                drawn[lo, hi] = _draw(_rng(seed, lo, hi), counts, (mid - lo) * shard)
            left = drawn[lo, hi]
            if s < mid:
                hi, counts = mid, left
            else:
                lo, counts, first = mid, counts - left, first + left
        return counts, first

    def draw(batches):
        drawn: dict = {}
        for rb in batches:
            for s in rb.column(0).to_pylist():
                if len(drawn) > 4096:
                    drawn.clear()
                counts, first = of_shard(s, drawn)
                size = int(counts.sum())
                place, at = permuted(np.arange(size), size, key("shard", s)), 0
                for no in np.flatnonzero(counts).tolist():
                    k = first[no] + np.arange(counts[no])
                    turn, index = k // blocks[no], k % blocks[no]
                    for p in np.unique(turn).tolist():
                        to = permuted(index[turn == p], blocks[no], key(no, p))
                        n = len(to)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int64)), pa.array(place[at : at + n].astype(np.int32)), *[pa.array(np.full(n, x, np.int32)) for x in (no, p)], pa.array(to)], schema=schema)
                        at += n

    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    return spark.range(0, shards, 1, tasks).mapInArrow(draw, "shard long, slot int, source_no int, pass int, block long")


#: What tells a document's rows apart where its id does not: see common.row_keyed.
ROW = ("_file", "_row")


def mix(docs: DataFrame, block: int = BLOCK, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its key, its source's figures and its place in the source's stream, slots of the mix)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = common.written(common.row_keyed(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"), *ROW))
    n = sized.count()
    # The order goes by id and text, so that reruns agree wherever the files lie; rows with one id, or none, are in many buckets.
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit(seed)), F.lit(max(1, n // BUCKET_DOCS))))
    sums = common.written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    # One row per source; refused where even those would be too many for the driver.
    found = sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    blocks, slots = plan(sizes, wanted, block, cap)
    schema = T.StructType.fromDDL("source_no int, name string, source_size long, target double, blocks long")
    figures = spark.createDataFrame([(i, r.source, sizes[i], wanted[i], blocks[i]) for i, r in enumerate(found)], schema)
    # Words before a bucket: those of the groups of buckets before, and of the buckets before in its group. No window holds a whole source.
    grouped = sums.withColumn("g", F.floor(F.col("bucket") / GROUP_BUCKETS).cast("long"))
    upto = lambda by, of: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("source", "g").agg(F.sum("words").alias("words")).select(F.col("source").alias("gs"), F.col("g").alias("gg"), upto(["source"], "g").alias("groups"))
    before = grouped.withColumn("inside", upto(["source", "g"], "bucket")).join(groups, F.col("source").eqNullSafe(F.col("gs")) & (F.col("g") == F.col("gg")))
    before = before.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("groups") + F.col("inside")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "th", "size", *ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(order))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.join(figures, F.col("source").eqNullSafe(F.col("name")))
    at = F.col("before") + F.col("upto") - F.col("size")
    return placed.select("doc_id", "source", "size", "source_no", "source_size", "target", at.alias("start"), *ROW), draw_slots(spark, blocks, slots, seed)


def spans(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document has words in: source_no, block, and the words' place in the document."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    d = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), last)))
    first = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    upto = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    return d.select("doc_id", "source_no", "start", "block", first.alias("first"), upto.alias("upto"), *ROW)


def shards(docs: DataFrame, block: int = BLOCK, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(a row per document as mix() gives it, the written mix).

    The mix has a row for each document's piece of a slot, ordered by shard, slot and place: shard, slot, pass, source_no,
    block, doc_id, start (the document's place in its source's stream), first and upto (the piece's words in the document),
    and the key of the document's row.
    """
    placed, slots = mix(docs, block, share, cap, weights, seed)
    placed = common.written(placed)
    # Spark takes the drawn slots for a small table, since it knows no size of theirs.
    joined = spans(placed, block).join(slots.hint("merge"), ["source_no", "block"])
    parts = common.parts_for(docs, SHARD_MB)
    out = joined.select("shard", "slot", "pass", "source_no", "block", "doc_id", "start", "first", "upto", *ROW).repartition(parts, "shard")
    return placed, common.written(out.sortWithinPartitions("shard", "slot", "start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, mixed = shards(common.table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("source_no", "start").agg(F.sum(F.col("upto") - F.col("first")).alias("taken"))
    # An empty document has no words, and may share its start with the next one.
    out = placed.join(taken.hint("merge"), (placed.source_no == taken.source_no) & (placed.start == taken.start) & (placed["size"] > 0), "left")
    return out.select(placed.doc_id, placed["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
