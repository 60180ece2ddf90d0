"""Products of vectors inside groups as matrices: mergeable Gram matrices, and sums over all pairs of a batch.

A Gram matrix is that of the vectors with a 1 in front, so that it holds the count, the sums and X'X at once, and two of
them merge by addition. A task multiplies the vectors of a group in one go and sends a partial matrix, cut into blocks of rows;
blocks are added up as they stream by, in two levels, so that a group of any size takes as many rows as it has
blocks and tasks, and no task holds more than a block of a group.

Null vectors are left out; a group's vectors have one length (another one is an error). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

#: Bytes of a block of matrix rows, and of the matrices that a task holds before it sends them.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 256 << 20
#: Vectors of a batch that one multiplication takes on each side.
SIDE = 1024


def _matrix(vectors: pa.Array) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of several lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _groups(rb: pa.RecordBatch, n: int):
    """(key, rows) of each group of the first n columns in a batch."""
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[rb.column(c).to_pylist() for c in range(n)], strict=True) if n else [()] * rb.num_rows):
        at.setdefault(key, []).append(i)
    return at.items()


def _cut(matrix: np.ndarray, size: int) -> list[bytes]:
    """Blocks of rows of an augmented matrix, about `size` bytes each; each starts with its first row (count and sums)."""
    rows = max(1, size // matrix[0].nbytes)
    return [np.concatenate([matrix[:1], matrix[k : k + rows]]).tobytes() for k in range(1, len(matrix), rows)]


def _partial(n: int, schema: pa.Schema, spread: int, size: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % spread
        held: dict[tuple, np.ndarray] = {}

        def sent():
            for key, matrix in held.items():
                for b, block in enumerate(_cut(matrix, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, b, salt, len(matrix), block), schema, strict=True)], schema=schema)
            held.clear()

        for rb in batches:
            for key, rows in _groups(rb, n):
                x = _matrix(rb.column(n).take(pa.array(rows)))
                x = np.column_stack([np.ones(len(x)), x])
                product = x.T @ x
                if key in held and held[key].shape != product.shape:
                    raise ValueError("vectors of several lengths")
                held[key] = held[key] + product if key in held else product
            if sum(m.nbytes for m in held.values()) > most:
                yield from sent()
        yield from sent()

    return run


def _merge(n: int, schema: pa.Schema):
    """Rows sorted by all but the block's bytes -> one row for each run of equal ones, the blocks added up."""

    def run(batches):
        key, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, total.tobytes()), schema, strict=True)], schema=schema)

        for rb in batches:
            keys = list(zip(*[rb.column(c).to_pylist() for c in range(len(schema) - 1)], strict=True))
            for this, block in zip(keys, rb.column(len(schema) - 1), strict=True):
                part = np.frombuffer(block.as_buffer(), np.float64)
                if this == key:
                    if len(part) != len(total):
                        raise ValueError("vectors of several lengths")
                    total += part
                else:
                    if key is not None:
                        yield row()
                    key, total = this, part.copy()
        if key is not None:
            yield row()

    return run


def _arrow(df: DataFrame, by: list[str], tail: list[tuple[str, pa.DataType]]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(df.select(*by).schema), *tail]) if by else pa.schema(tail)


def gram(df: DataFrame, by: list[str], vector: str, size: int = BLOCK_BYTES, most: int = HELD_BYTES) -> DataFrame:
    """by, block, side, part: the augmented matrix of each group in blocks of rows of `size` bytes, as bytes of doubles; a task holds `most` bytes."""
    v = df.where(F.col(vector).isNotNull()).select(*by, F.transform(F.col(vector), lambda x: x.cast("double")).alias("_v"))
    spread = max(1, int(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    salted = _arrow(v, by, [("block", pa.int32()), ("salt", pa.int32()), ("side", pa.int32()), ("part", pa.binary())])
    keys = StructType([v.schema[c] for c in by])
    out = v.mapInArrow(_partial(len(by), salted, spread, size, most), keys.add("block", "integer").add("salt", "integer").add("side", "integer").add("part", "binary"))
    schema = out.schema
    for level in (["salt"], []):
        on = [*by, "block", *level]
        out = out.select(*by, "block", *level, "side", "part").repartition(*on).sortWithinPartitions(*on, "side")
        names = [*by, "block", *level, "side", "part"]
        arrow = pa.schema([salted.field(c) for c in names])
        out = out.mapInArrow(_merge(len(on), arrow), StructType([schema[c] for c in names]))
    return out


def _figures(part: bytes, side: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(count, means, rows of X'X in this block, covariances of these rows) of a block."""
    m = np.frombuffer(part, np.float64).reshape(-1, side)
    n, sums, rows = m[0, 0], m[0, 1:], m[1:, 1:]
    own = m[1:, 0]  # sums of the components that these rows belong to
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, sums / n, rows, (rows - np.outer(own, sums) / n) / (n - 1)


def moments(df: DataFrame, by: list[str], vector: str, size: int = BLOCK_BYTES, most: int = HELD_BYTES) -> DataFrame:
    """AGG-18: by, i, j, n, mean_i, cov: count, means and sample covariances of vectors per group (null for one vector)."""
    blocks = gram(df, by, vector, size, most)
    tail = [("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("mean_i", pa.float64()), ("cov", pa.float64())]
    schema = _arrow(blocks, by, tail)

    def run(batches):
        for rb in batches:
            for *key, block, side, part in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                n, mean, rows, cov = _figures(part, side)
                first = block * max(1, size // (8 * side))
                for r in range(len(rows)):
                    d = side - 1
                    values = [*[pa.array([k] * d, f.type) for k, f in zip(key, schema, strict=False)], pa.array(np.full(d, first + r), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, int(n)), pa.int64()), pa.array(np.full(d, mean[first + r])), pa.array(cov[r], mask=np.full(d, n < 2))]
                    yield pa.RecordBatch.from_arrays(values, schema=schema)

    return blocks.mapInArrow(run, StructType([blocks.schema[c] for c in by]).add("i", "integer").add("j", "integer").add("n", "long").add("mean_i", "double").add("cov", "double"))


def matrices(df: DataFrame, by: list[str], vector: str) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """{group: (count, means, covariances)} on the driver: d x d numbers a group, for few groups."""
    out: dict[tuple, list] = {}
    for r in gram(df, by, vector).collect():
        n, mean, rows, cov = _figures(r.part, r.side)
        out.setdefault(tuple(r[c] for c in by), []).append((r.block, n, mean, cov))
    return {k: (int(x[0][1]), x[0][2], np.concatenate([b[3] for b in sorted(x, key=lambda b: b[0])])) for k, x in out.items()}


def dispersive(df: DataFrame, batch: str, key: str, vector: str, tau: float = 0.5, side: int = SIDE) -> DataFrame:
    """MTH-04: batch, loss: log of the mean of exp(-|a - b|^2 / tau) over all pairs of unit vectors of a batch with different keys.

    A batch is dealt by hash to blocks of about SIDE vectors, and pairs of blocks meet: that many vectors travel as one row, and
    their pairs never become rows. Exponents are in [-4 / tau, 0], so they need no shift by the largest.
    """
    v = df.where(F.col(vector).isNotNull()).select(F.col(batch).alias("batch"), F.col(key).cast("long").alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    sizes = v.groupBy(F.col("batch").alias("_batch")).agg(F.ceil(F.count("*") / F.lit(float(side))).alias("_blocks"))
    dealt = v.join(sizes, F.col("batch").eqNullSafe(F.col("_batch"))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")))
    dealt = dealt.select("batch", "block", "key", "v").repartition("batch", "block").sortWithinPartitions("batch", "block")
    number = v.schema["batch"]
    schema = _arrow(v, ["batch"], [("block", pa.int64()), ("piece", pa.int32()), ("keys", pa.list_(pa.int64())), ("x", pa.binary())])

    def gathered(batches):
        """Blocks of at most SIDE vectors of one (batch, block); more vectors than expected go on in another piece."""
        at, piece, keys, held = None, 0, [], []

        def row():
            x = np.concatenate(held)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, piece, keys, x.tobytes()), schema, strict=True)], schema=schema)

        for rb in batches:
            for this, rows in _groups(rb, 2):
                for k in range(0, len(rows), side):
                    part = pa.array(rows[k : k + side])
                    if held and (this != at or len(keys) + len(part) > side):
                        yield row()
                        piece = piece + 1 if this == at else 0
                        keys, held = [], []
                    elif this != at:
                        piece = 0
                    at = this
                    keys += rb.column(2).take(part).to_pylist()
                    held.append(_matrix(rb.column(3).take(part)))
        if held:
            yield row()

    kind = StructType([number]).add("block", "long").add("piece", "integer").add("keys", ArrayType(LongType())).add("x", "binary")
    blocks = dealt.mapInArrow(gathered, kind).withColumn("at", F.struct("block", "piece")).drop("block", "piece")
    pairs = blocks.alias("a").join(blocks.alias("b").hint("merge"), F.col("a.batch").eqNullSafe(F.col("b.batch")) & (F.col("a.at") <= F.col("b.at")))
    pairs = pairs.select("a.batch", F.col("a.keys").alias("ak"), F.col("a.x").alias("ax"), F.col("b.keys").alias("bk"), F.col("b.x").alias("bx"), F.when(F.col("a.at") == F.col("b.at"), 1).otherwise(2).alias("times"))
    summed = _arrow(v, ["batch"], [("s", pa.float64()), ("n", pa.int64())])

    def summing(batches):
        for rb in batches:
            rows = []
            for g, ak, ax, bk, bx, times in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                a, b = (np.frombuffer(x, np.float64).reshape(len(k), -1) for x, k in ((ax, ak), (bx, bk)))
                other = np.array([-1 if k is None else k for k in ak])[:, None] != np.array([-1 if k is None else k for k in bk])[None]
                e = np.exp(-np.maximum(2 - 2 * (a @ b.T), 0) / tau)
                rows.append((g, times * float(e[other].sum()), times * int(other.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(summed)], schema=summed)

    sums = pairs.mapInArrow(summing, StructType([number]).add("s", "double").add("n", "long"))
    return sums.groupBy("batch").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").select("batch", F.log(F.col("s") / F.col("n")).alias("loss"))
