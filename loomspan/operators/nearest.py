"""MTH-03: nearest vectors by cosine similarity, exact, for a stated query set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.scan import ranged
from loomspan.operators.tables import written

#: Queries that travel to the vectors at a time, and vectors that one multiplication takes.
BLOCK, SLICE = 4096, 1024
FOUND = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("sim", pa.float64())])


def _unit(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(qid: np.ndarray, vec: np.ndarray, sim: np.ndarray, k: int):
    """The k best of each query: larger similarity first, then smaller id."""
    order = np.lexsort((vec, -sim, qid))
    qid, vec, sim = qid[order], vec[order], sim[order]
    first = np.maximum.accumulate(np.where(np.append(True, qid[1:] != qid[:-1]), np.arange(len(qid)), 0))
    keep = np.arange(len(qid)) - first < k
    return qid[keep], vec[keep], sim[keep]


def top(queries: DataFrame, vectors: DataFrame, key: str, column: str, k: int, block: int = BLOCK, places: int = 6) -> DataFrame:
    """qid, vec_id, sim: the k vectors most similar to each query but itself, by similarity rounded to `places`, then by id.

    The work is queries x vectors by definition. Queries go out in blocks of `block` by their places, a broadcast of that proven
    size each, which is released when the block's rows are written; a task keeps k rows a query, so nothing else is shuffled.
    Null vectors match nothing; all vectors have one length.
    """
    spark = queries.sparkSession
    queries, vectors = queries.where(F.col(column).isNotNull()).select(key, column), vectors.where(F.col(column).isNotNull()).select(key, column)
    queries = ranged(queries, [], key).running(_at=("count", None)).rows().withColumn("_block", F.floor((F.col("_at") - 1) / F.lit(block)))
    queries = written(queries)
    out = spark.createDataFrame([], "qid long, vec_id long, sim double")
    for b in range(-(-queries.count() // block)):
        held = queries.where(F.col("_block") == b).toArrow()
        sent = spark.sparkContext.broadcast((held[key].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64), _unit(held[column].combine_chunks())))

        def run(batches, sent=sent):
            ids, q = sent.value
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            least = np.full(len(ids), -np.inf)
            place = {int(x): i for i, x in enumerate(ids.tolist())}
            for rb in batches:
                for at in range(0, rb.num_rows, SLICE):
                    some = rb.slice(at, SLICE)
                    vec = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    sims = np.round(q @ _unit(some.column(1)).T, places)
                    i, j = np.nonzero(sims >= least[:, None])
                    other = ids[i] != vec[j]
                    i, j = i[other], j[other]
                    found = list(_best(*(np.concatenate(x) for x in zip(found, (ids[i], vec[j], sims[i, j]), strict=True)), k))
                    n = np.unique(found[0], return_counts=True)
                    for x, c, worst in zip(n[0].tolist(), n[1].tolist(), found[2][np.cumsum(n[1]) - 1].tolist(), strict=True):
                        if c == k:
                            least[place[x]] = worst
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, FOUND, strict=True)], schema=FOUND)

        ranked = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
        found = vectors.mapInArrow(run, "qid long, vec_id long, sim double").withColumn("r", ranked)
        out = out.union(written(found.where(F.col("r") <= k).drop("r")))
        sent.unpersist()
    return out
