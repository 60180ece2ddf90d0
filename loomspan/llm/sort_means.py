"""Centroid clustering by sort-means, exact in integers.

Vectors are quantised to integers and written once, in blocks, to a table bucketed by block. Each round the centroids are
compared with each other, and for each centroid the others are sorted by distance. A vector starts at the centroid that
it had before and walks that order; beyond twice its distance to that centroid no other can be nearer, so the walk stops
there (strictly beyond, so that a tie still goes to the smaller number). All vectors of a block that share a previous
centroid walk together, the farthest first, so that those still walking are a prefix.

A round writes a byte or two for each vector, in a table bucketed as the vectors are: the next round joins the two without
a shuffle, and no round writes vectors again. Sums travel once a task. The driver holds the centroids, k rows.

Vectors with another number of components, or with a null or non-finite one, are left out; repeated rows and ids are vectors
of their own, and a null id is written `null` where ids are hashed. With fewer vectors than k there are as many centroids
as vectors; an empty table gives no rows. Components beyond LARGEST in size after quantising are an error, since their
distances would not fit a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS, K, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest quantised component: the squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Largest one whose squared distances doubles hold exactly.
EXACT = 1 << 22
#: Vectors in a block, and MB of input files in a bucket; Spark's own limit of buckets.
BLOCK, BUCKET_MB, MOST_BUCKETS = 1024, 64, 100_000


def kept(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS) -> DataFrame:
    """key, x (array of doubles): the vectors that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    bad = F.exists(F.col("x"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("key"), v.alias("x")).where((F.size("x") == dims) & ~bad)


def _quantised(x: pa.Array, dims: int) -> np.ndarray:
    q = np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    if len(q) and np.abs(q).max() > LARGEST:
        raise ValueError(f"a component of over {LARGEST} / {SCALE}: its distances don't fit a long")
    return q.astype(np.int32)


def _blocks(dims: int):
    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("x", pa.binary())])
        for rb in batches:
            for start in range(0, rb.num_rows, BLOCK):
                part = rb.slice(start, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.column(0).to_pylist()], schema[1].type), pa.array([_quantised(part.column(1), dims).tobytes()])], schema=schema)
                at += 1

    return run


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one integer point, exact."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT else np.int64
    d = x.astype(kind) - c.astype(kind)
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row of x, the smaller number at ties, walking from the one `before`."""
    between = np.stack([distances(centroids, c) for c in centroids])
    to, far = before.astype(np.int64), np.zeros(len(x), np.int64)
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        own = distances(x[rows], centroids[c])
        rows, own = (a[np.argsort(-own, kind="stable")] for a in (rows, own))
        best, at = own.copy(), np.full(len(rows), c)
        for j in np.argsort(between[c], kind="stable").tolist():
            if j == c:
                continue
            # Still walking: those with 4 * own >= between, without the overflow.
            n = int(np.searchsorted(-own, -(-(-between[c, j] // 4)), side="right"))
            if not n:
                break
            d = distances(x[rows[:n]], centroids[j])
            better = (d < best[:n]) | ((d == best[:n]) & (j < at[:n]))
            best[:n], at[:n] = np.where(better, d, best[:n]), np.where(better, j, at[:n])
        to[rows], far[rows] = at, best
    return to, far


def _before(raw: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, np.int64) if raw is None else np.frombuffer(raw, "<u2").astype(np.int64)


def _round(centroids: np.ndarray, dims: int):
    """Blocks (block, x, before) -> block, before, totals; the last block of a task carries its counts and sums."""
    schema = pa.schema([("block", pa.int64()), ("before", pa.binary()), ("totals", pa.list_(pa.int64()))])
    k = len(centroids)

    def run(batches):
        counts, sums, held = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), None
        for rb in batches:
            for block, raw, old in zip(*(rb.column(i) for i in range(3)), strict=True):
                x = np.frombuffer(raw.as_py(), np.int32).reshape(-1, dims)
                to, _ = nearest(x, _before(old.as_py(), len(x)), centroids)
                counts += np.bincount(to, minlength=k)
                for c in np.unique(to).tolist():
                    sums[c] += x[to == c].sum(axis=0, dtype=np.int64)
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.nulls(1, schema[2].type)], schema=schema)
                held = (block.as_py(), to.astype("<u2").tobytes())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([np.column_stack([counts, sums]).ravel().tolist()], schema[2].type)], schema=schema)

    return run


def _last(centroids: np.ndarray, dims: int):
    schema = pa.schema([("key", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for rb in batches:
            for keys, raw, old in zip(*(rb.column(i) for i in range(3)), strict=True):
                x = np.frombuffer(raw.as_py(), np.int32).reshape(-1, dims)
                to, far = nearest(x, _before(old.as_py(), len(x)), centroids)
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(to, pa.int32()), pa.array(far)], schema=schema)

    return run


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df written in the shared folder as a table bucketed by block; the name lives in the session's catalog."""
    spark, name = df.sparkSession, f"loomspan_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", common.shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def start(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose sha256 of prefix and id is smallest, in that order; equal hashes go by components."""
    h = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(h.alias("h"), "x").orderBy("h", "x").limit(k).toArrow()
    x = rows["x"].combine_chunks()
    return _quantised(x, len(x[0])) if len(x) else np.zeros((0, 0), np.int32)


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, prefix: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance of each vector; the centroids, a row each)."""
    if k > 1 << 16:
        raise ValueError("centroids are numbered in two bytes")
    spark = vectors.sparkSession
    taking = kept(vectors, key, column, dims)
    centroids = start(taking, k, prefix).astype(np.int64)
    if not len(centroids):
        return spark.createDataFrame([], "key long, cluster int, distance long"), centroids
    buckets = min(MOST_BUCKETS, common.parts_for(vectors, BUCKET_MB))
    blocks = _bucketed(taking.mapInArrow(_blocks(dims), "block long, keys array<long>, x binary").repartition(buckets, "block"), buckets)
    before = None

    def placed(*columns: str) -> DataFrame:
        if before is None:
            return blocks.select(*columns, F.lit(None).cast("binary").alias("before"))
        # Both tables are bucketed by block: the join moves no row. The small side is hashed, so blocks are not sorted.
        return blocks.join(before.select("block", "before").hint("shuffle_hash"), "block").select(*columns, "before")

    for _ in range(rounds):
        before = _bucketed(placed("block", "x").mapInArrow(_round(centroids, dims), "block long, before binary, totals array<long>"), buckets)
        totals = before.where("totals is not null").select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        at = {r["at"]: int(r["n"]) for r in totals.collect()}  # k * (dims + 1) numbers
        for c in range(len(centroids)):
            count, *sums = (at[c * (dims + 1) + i] for i in range(dims + 1))
            if count:
                centroids[c] = [s // count for s in sums]
    return common.written(placed("keys", "x").mapInArrow(_last(centroids, dims), "key long, cluster int, distance long")), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(common.table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()  # a row a centroid
    total = sum(r.n for r in sums)
    figures = spark.createDataFrame([(r.cluster, r.n, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(dims: int = DIMS, k: int = K, rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other."""
    nearest_sql = """a{r} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS b FROM
    (SELECT r, c, list_sum(list_transform(list_zip(q.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q, c{r}) GROUP BY r)"""
    parts = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings\n"
        f"    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM q)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT * FROM p ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            nearest_sql.format(r=r),
            f"""n{r} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM
    (SELECT b.c AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT b, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{r} JOIN q USING (r)) GROUP BY ALL) GROUP BY c)""",
            f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c))",
        ]
    parts.append(nearest_sql.format(r=rounds))
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia,
    (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN q USING (r) JOIN c{rounds} z ON z.c = b.c"""
    )


ORACLE_SQL = _oracle()
