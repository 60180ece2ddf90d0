"""All queries of the reference operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curation, evaluation, formats, joins, ledger, media, mixture, streams, vectors  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture query with a hold-out that fits the smallest scale."""
    return mixture.bucket_mix(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), 100)
