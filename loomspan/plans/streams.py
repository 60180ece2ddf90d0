"""Streaming queries, each with its batch twin as SQL (STM)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import shared_base
from loomspan.sources import members
from loomspan.streaming import early_stop, ingest

from .ledger import EARLY
from .registry import ORACLES, QUERIES


def _folder(spark: SparkSession) -> str:
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


def stm05_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of `events` through the file stream: errors are dead letters, each event once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    where = _folder(spark)
    ingest.run(spark, f"{sf_dir}/events.parquet*", schema, where, f"{where}/checkpoint", F.col("event_type") != "error", ["event_id"])
    return spark.read.schema(schema).parquet(f"{where}/rows/*").select("event_id", "event_type", "value")


def stm12_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    where = _folder(spark)
    ingest.run(spark, f"{sf_dir}/events.parquet*", schema, where, f"{where}/checkpoint", F.col("event_type") != "error", ["event_id"])
    return spark.read.schema(schema).parquet(f"{where}/dead/*").groupBy("event_type").agg(F.count("*").alias("n"))


def stm09_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    where = _folder(spark)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    out = early_stop.track(stream.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value"), 1.015)
    out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.col("step").alias("event_id"), "best", "bad")


def stm06_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice through the stream, in two files: what is read, kept, dead and repeated."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    where = _folder(spark)
    for k in (0, 1):
        e.coalesce(1).write.parquet(f"{where}/in/{k}")
    ingest.run(spark, f"{where}/in", e.schema, where, f"{where}/checkpoint", F.col("event_type") != "error", ["event_id"], 1)
    return ingest.counters(spark, where)


def stm07_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of five files is stopped after each of its first two batches and goes on; no event is lost or doubled."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    where = _folder(spark)
    for k in range(5):
        e.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(f"{where}/in/{k}")
    for stop in (lambda: True, lambda: True, None):
        ingest.run(spark, f"{where}/in", e.schema, where, f"{where}/checkpoint", F.lit(True), ["event_id"], 1, stop=stop)
    return spark.read.schema(e.schema).parquet(f"{where}/rows/*").select("event_id", "event_type")


def _digests(members_: DataFrame) -> DataFrame:
    return members_.select(F.col("name").cast("long").alias("doc_id"), F.length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def src07_member_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as members of tar shards, which are read back by marks: a shard by several tasks."""
    where = _folder(spark)
    members.write(_texts(spark, sf_dir), "doc_id", "text", f"{where}/tars")
    members.index(spark, f"{where}/tars", f"{where}/marks", 1 << 20)
    return _digests(members.read(spark, f"{where}/marks"))


def stm01_member_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shards as a stream that admits some megabytes a batch and stops inside shards (STM-01, STM-03, STM-04)."""
    where = _folder(spark)
    members.write(_texts(spark, sf_dir), "doc_id", "text", f"{where}/tars")
    members.index(spark, f"{where}/tars", f"{where}/marks", 1 << 20)
    members.drain(members.stream(spark, f"{where}/marks", f"{where}/progress", 16 << 20), f"{where}/out", f"{where}/checkpoint")
    return _digests(spark.read.schema(members.MEMBERS).parquet(f"{where}/out"))


def stm10_late_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer takes a source, is stopped, a late source comes in and is checked, and the consumer goes on where it stood (STM-10)."""
    where, texts = _folder(spark), _texts(spark, sf_dir)
    taken = []
    for late in (False, True):
        members.write(texts.where((F.col("doc_id") % 3 == 0) == F.lit(late)), "doc_id", "text", f"{where}/tars/{'b' if late else 'a'}")
        marks = members.index(spark, f"{where}/tars", f"{where}/marks", 1 << 20)
        members.drain(members.stream(spark, f"{where}/marks", f"{where}/progress", 16 << 20), f"{where}/out", f"{where}/checkpoint")
        out = spark.read.schema(members.MEMBERS).parquet(f"{where}/out")
        taken.append((late, marks.agg(F.sum("members")).first()[0] or 0, out.count()))
    stops = spark.createDataFrame(taken, "late boolean, indexed long, taken long")
    own = _digests(out).withColumn("late", F.col("doc_id") % 3 == 0)
    return own.join(F.broadcast(stops), "late").select("doc_id", "sha256", "late", "indexed", "taken")


QUERIES.update({"src07_member_ranges": src07_member_ranges, "stm01_member_stream": stm01_member_stream, "stm10_late_source": stm10_late_source})
MEMBERS_SQL = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"
ORACLES.update({
    "src07_member_ranges": MEMBERS_SQL,
    "stm01_member_stream": MEMBERS_SQL,
    "stm10_late_source": f"WITH m AS ({MEMBERS_SQL}), n AS (SELECT count(*) FILTER (WHERE doc_id % 3 <> 0)::bigint AS early, count(*)::bigint AS n FROM documents) SELECT doc_id, sha256, doc_id % 3 = 0 AS late, CASE WHEN doc_id % 3 = 0 THEN n ELSE early END AS indexed, CASE WHEN doc_id % 3 = 0 THEN n ELSE early END AS taken FROM m, n",
})
QUERIES.update({"stm06_counters": stm06_counters, "stm07_stop": stm07_stop, "stm05_ingest": stm05_ingest, "stm12_dead_letters": stm12_dead_letters, "stm09_early_stop": stm09_early_stop})
ORACLES.update({
    "stm06_counters": "SELECT 2 * count(*)::bigint AS read, count(*) FILTER (WHERE event_type <> 'error')::bigint AS kept, 2 * count(*) FILTER (WHERE event_type = 'error')::bigint AS dead, count(*) FILTER (WHERE event_type <> 'error')::bigint AS repeated FROM events",
    "stm07_stop": "SELECT event_id, event_type FROM events",
    "stm05_ingest": "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'",
    "stm12_dead_letters": "SELECT event_type, count(*)::bigint AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "stm09_early_stop": EARLY,
})
