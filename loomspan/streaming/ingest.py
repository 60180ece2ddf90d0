"""Streaming ingest: files in, dead letters aside, each (source, id) once, hold-out flagged (STM-01..12).

The file source keeps offsets and finished files in the checkpoint, bounds what is in flight by files per trigger, and an
availableNow run that finds nothing new does nothing. A batch that runs again writes the same rows: its folder is
named by the batch and replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.operators.key_index import PREFIX_KEYS, KeyIndex
from loomspan.operators.tables import spread


class _Stopped(Exception):
    """Ends a stream between two batches; the batch that it keeps out has written nothing."""


def split(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """STM-12: (good rows, dead letters)."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def new_rows(batch: DataFrame, seen: DataFrame | None, keys: list[str]) -> DataFrame:
    """STM-05: rows of a batch whose key is new, once each; null keys are keys."""
    rows = batch.dropDuplicates(keys)
    if seen is None:
        return rows
    same = functools.reduce(lambda x, y: x & y, [rows[k].eqNullSafe(seen[k]) for k in keys])
    return rows.join(seen, same, "left_anti")


def run(spark: SparkSession, source: str, schema: StructType, where: str, checkpoint: str, ok, keys: list[str], files_per_trigger: int = 4, on_batch: Callable[[int], None] | None = None, stop: Callable[[], bool] | None = None) -> None:
    """Reads Parquet files under `source` until none is left; good rows go to where/rows, bad ones to where/dead.

    A row's key is looked up in an index of the keys that batches have taken (STM-05): filters first, then the keys that may be
    known. A batch is counted and dealt by key to tasks of some rows, so a large file is not one task's sort. Counters of each
    batch (read, kept, dead, repeated) go to where/ledger (STM-06); they are observed while the rows are written. `stop` is asked after every batch: where it says so, the stream ends there with
    its checkpoint (STM-07), and the next run goes on. A batch that a stop or a crash cut short runs again and replaces what it wrote.
    """
    index = KeyIndex(spark, f"{where}/keys", StructType([schema[k] for k in keys]))
    stopping: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        if stopping:
            raise _Stopped
        batch = spread(batch, *keys, rows=PREFIX_KEYS).persist()
        good, dead = split(batch, ok)
        seen, kept, bad = Observation(), Observation(), Observation()
        n = F.count(F.lit(1)).alias("n")
        known = index.known(good, number) if index.runs() else None
        new = new_rows(good.observe(seen, n), known, keys).observe(kept, n)
        new.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")
        dead.observe(bad, n).write.mode("overwrite").parquet(f"{where}/dead/batch={number}")
        index.add(spark.read.schema(schema).parquet(f"{where}/rows/batch={number}"), number)
        read, taken, failed = (o.get["n"] for o in (seen, kept, bad))
        counts = spark.createDataFrame([(read + failed, taken, failed, read - taken)], "read long, kept long, dead long, repeated long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{where}/ledger/batch={number}")
        index.release()
        batch.unpersist()
        if on_batch:
            on_batch(number)
        if stop and stop():
            stopping.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopping:
            raise


def counters(spark: SparkSession, where: str) -> DataFrame:
    """STM-06: read, kept, dead and repeated rows of all batches."""
    d = spark.read.schema("read long, kept long, dead long, repeated long").parquet(f"{where}/ledger/*")
    return d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "kept", "dead", "repeated")])
