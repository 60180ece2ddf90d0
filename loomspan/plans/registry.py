"""Where plans register their queries: key -> Spark query, and key -> SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers tables -> DataFrame under a key; `sql` is its twin over the same tables."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def u01_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::bigint / 4503599627370496::double)"


def words_sql(text: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: w <> ''))"
