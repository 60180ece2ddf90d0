"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from loomspan.session import shared_base

#: Rows of a task whose rows are dear: pictures, models.
DEAR = 8_192


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table, reread: what follows reads it instead of making it again, and it outlives executors."""
    path = f"{shared_base(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = DEAR, n: int | None = None) -> DataFrame:
    """df dealt by keys to tasks of about `rows` rows; n: how many df has, where that is known.

    Small files, and those of one row group, are a single task's otherwise, however long its rows take.
    """
    n = df.count() if n is None else n
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), *keys)
