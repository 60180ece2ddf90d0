"""Best-fit packing of token pieces into sequences of at most `capacity` tokens.

Bounded-space online best fit: a fixed number of open bins, found through a bitset keyed by free space.
A piece goes to the open bin with the least free space that still takes it. Where none does and all
bins are open, the fullest closes first. Only documents of over `capacity` tokens are cut.

Pieces come in an order by hash, so that every stretch of them has long and short ones, and pass a buffer of AHEAD
pieces that lets the long ones of a stretch go first. (Long ones of the whole input first would fill and close the open bins
before short pieces come.) Memory is bounded by the buffer and the open bins.

Null texts are empty and get the end id alone; repeated rows are pieces of their own; ties between bins
go to the one that reached its free space last. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenize import default_path, ids_of

CAPACITY = 4096
#: Open bins of one packer: memory is bounded by this, whatever the number of pieces.
OPEN_BINS = 4096
#: Pieces of the buffer before the bins; more would let the long ones alone fill the open bins.
AHEAD = 4 * OPEN_BINS
#: Pieces that one packer sees. Each leaves a few bins part full, so there are few packers.
PIECES_PER_PACKER = 200_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bins:
    """Open bins of one packer. place() returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins, self.by_free, self.mask, self.open, self.next = capacity, open_bins, {}, 0, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
                self.open -= 1
            b, free = self.next, self.capacity
            self.next += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.mask |= 1 << left
        else:
            self.open -= 1
        return b, self.capacity - free


def pieces(docs: DataFrame, vocabulary: str, kind: str, end_id: int, capacity: int = CAPACITY, keep_cache: bool = True) -> DataFrame:
    """Tokens of each document cut into pieces of at most `capacity`; ids stay behind, their checksum goes on.

    keep_cache: workers keep the chunks they know for their next task; without it each task ends with an empty cache.
    """

    def cut(batches):
        end = end_id.to_bytes(4, "little")
        coder = ids_of(vocabulary, kind)
        for rb in batches:
            out = []
            for at in range(0, rb.num_rows, 2048):
                part = rb.slice(at, 2048)
                for key, ids in zip(part.column(0).to_pylist(), coder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[i : i + 4 * capacity]
                        out.append((key, k, i // 4, len(piece) // 4, zlib.crc32(piece)))
            yield common.batch({n: [x[i] for x in out] for i, n in enumerate(PIECES.names)}, PIECES)
        if not keep_cache:
            coder.cache.clear()
            ids_of.cache_clear()
            common.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def pack(found: DataFrame, packers: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, ahead: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset. Each packer takes a hash share of the pieces.

    The order is total, so that a task that runs again packs alike; only rows equal in all columns may swap.
    `ahead` is 4 pieces an open bin unless given.
    """
    ahead = ahead or AHEAD * open_bins // OPEN_BINS

    def run(batches):
        from pyspark import TaskContext

        bins, first, held, n = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40, [], 0

        def placed():
            rows = pa.Table.from_batches(held).combine_chunks().select(PIECES.names)
            rows = rows.take(np.argsort(-rows["length"].to_numpy(), kind="stable"))
            put = [bins.place(x) for x in rows["length"].to_pylist()]
            columns = [*[c.combine_chunks() for c in rows.columns], pa.array([first + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=PACKED)

        for rb in batches:
            while rb.num_rows:
                held.append(rb.slice(0, ahead - n))
                n, rb = n + held[-1].num_rows, rb.slice(ahead - n)
                if n == ahead:
                    yield placed()
                    held, n = [], 0
        if held:
            yield placed()

    mixed = found.withColumn("mixed", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = mixed.repartition(packers, "mixed").sortWithinPartitions("mixed", "doc_id", "piece", "ids_crc32", "length").drop("mixed")
    return dealt.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def packers_for(docs: DataFrame, per: int = PIECES_PER_PACKER) -> int:
    return max(1, -(-docs.count() // per))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack(pieces(docs, default_path("word_bpe_49k.json"), "word_bpe", 1), packers_for(docs))
