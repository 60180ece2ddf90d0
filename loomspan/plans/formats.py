"""Queries of formats, sinks and contracts: tables of fixed size are written in a format and read back (SRC, SNK, UDF)."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import models
from loomspan.operators import evaluate as E
from loomspan.operators import store
from loomspan.session import shared_base
from loomspan.sources import archives, fetch, files, tfrecord
from loomspan.sources.remote import filesystem
from loomspan.streaming import ingest

from .registry import ORACLES, QUERIES, query


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/formats-{uuid.uuid4().hex}"


def put(where: str, name: str, data: bytes) -> None:
    system, base = filesystem(where)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data)


def fixed(key: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame."""

    def add(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 rows that the written files hold."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()


def tarred(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


@fixed("src03_footer", "SELECT count(*)::bigint AS n_rows, 3::bigint AS columns FROM nation")
def src03(spark, sf_dir):
    where = folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.parquet(where)
    return files.parquet_peek(spark, where).select("n_rows", "columns")


@fixed("src04_row_group", "SELECT n_nationkey::bigint AS k FROM nation")
def src04(spark, sf_dir):
    where = folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.parquet(where)
    files.register(spark)
    rows = spark.read.format("loomspan_row_group").option("path", where).load()
    return rows.select(F.get_json_object("row", "$.n_nationkey").cast("bigint").alias("k"))


@fixed("src05_nested_json", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src05(spark, sf_dir):
    where = folder(spark)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    body = {"images": [{"id": r.r_regionkey, "r_name": r.r_name} for r in regions], "annotations": [{"image_id": r.n_regionkey, "n_name": r.n_name} for r in nations(spark, sf_dir)]}
    put(where, "captions.json", json.dumps(body, indent=1).encode())
    images, notes = files.nested_json(spark, f"{where}/captions.json")
    return images.join(notes, F.col("id") == F.col("image_id")).select("n_name", "r_name")


@fixed("src06_zip_fallback", "SELECT n_name AS name, n_nationkey % 2 = 0 AS zipped FROM nation")
def src06(spark, sf_dir):
    where, rows, out = folder(spark), nations(spark, sf_dir), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in rows:
            if r.n_nationkey % 2 == 0:
                z.writestr(r.n_name, b"zip")
    put(where, "images.zip", out.getvalue())
    archives.register(spark)
    wanted = spark.createDataFrame([(r.n_name,) for r in rows], "name string")
    missing = fetch.fetched(wanted.withColumn("url", F.col("name")), "url", 2, lambda url: b"url").select("name", "data")
    got = archives.with_fallback(wanted, spark.read.format("loomspan_zip").option("path", where).load(), missing)
    return got.select("name", (F.decode("data", "utf-8") == "zip").alias("zipped"))


@fixed("src07_tar_pairs", "SELECT n_nationkey::varchar AS key, n_name AS text FROM nation WHERE n_nationkey % 3 <> 0")
def src07(spark, sf_dir):
    """Pictures first, then their JSON in another order and folder: pairs meet by base name."""
    where = folder(spark)
    rows = nations(spark, sf_dir)
    entries = [(f"a/{r.n_nationkey}.webp", b"picture") for r in rows]
    entries += [(f"b/{r.n_nationkey}.json", json.dumps({"name": r.n_name}).encode() if r.n_nationkey % 3 else b"{broken") for r in reversed(rows)]
    put(where, "shard.tar", tarred(entries))
    archives.register(spark)
    return spark.read.format("loomspan_tar_pairs").option("path", where).load().select("key", F.get_json_object("text", "$.name").alias("text"))


@fixed("src08_tar_head", "SELECT n_nationkey::varchar AS key, CASE n_nationkey WHEN 0 THEN 't' END AS text FROM nation WHERE n_nationkey < 4")
def src08(spark, sf_dir):
    """A member takes 1024 bytes; 6600 bytes hold a picture with text, one without, one with broken JSON, and one whose text is cut."""
    where = folder(spark)
    texts = {0: ("txt", b"t"), 2: ("json", b"{broken"), 3: ("txt", b"t")}
    entries = []
    for r in nations(spark, sf_dir):
        entries.append((f"{r.n_nationkey}.png", b"p"))
        if r.n_nationkey in texts:
            entries.append((f"{r.n_nationkey}.{texts[r.n_nationkey][0]}", texts[r.n_nationkey][1]))
    put(where, "shard.tar", tarred(entries))
    archives.register(spark)
    rows = spark.read.format("loomspan_tar_pairs").option("path", where).option("headBytes", 6600).load()
    return rows.select("key", F.get_json_object("text", "$.txt").alias("text"))


@fixed("src09_tar_json", "SELECT n_name AS name FROM nation")
def src09(spark, sf_dir):
    where = folder(spark)
    put(where, "records.tar", tarred([(f"{r.n_nationkey}.json", json.dumps({"name": r.n_name}).encode()) for r in nations(spark, sf_dir)]))
    archives.register(spark)
    return spark.read.format("loomspan_tar_json").option("path", where).load().select(F.get_json_object("text", "$.name").alias("name"))


@fixed("src10_json_lines_head", "SELECT n_nationkey::bigint AS k FROM nation WHERE n_nationkey < 24 AND n_nationkey <> 7")
def src10(spark, sf_dir):
    """The last line never counts, and line 7 is broken."""
    where = folder(spark)
    put(where, "rows.jsonl", "\n".join("{" if r.n_nationkey == 7 else json.dumps({"k": r.n_nationkey}) for r in nations(spark, sf_dir)).encode())
    return files.json_lines_head(spark, f"{where}/rows.jsonl", "k bigint", 1 << 20).select("k")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def example(name: bytes, key: int) -> bytes:
    entries = ((b"name", _field(1, _field(1, name))), (b"key", _field(3, _field(1, _varint(key)))))
    return _field(1, b"".join(_field(1, _field(1, k) + _field(2, v)) for k, v in entries))


@fixed("src11_tfrecord", "SELECT n_name AS name, n_nationkey::bigint AS k FROM nation")
def src11(spark, sf_dir):
    where, out = folder(spark), b""
    for r in nations(spark, sf_dir):
        data = example(r.n_name.encode(), r.n_nationkey)
        out += struct.pack("<Q", len(data)) + b"\0" * 4 + data + b"\0" * 4
    put(where, "x.tfrecord", out + out[:20])  # the truncated tail is left out
    tfrecord.register(spark)
    rows = spark.read.format("loomspan_tfrecord").option("path", where).load()
    name = F.max(F.when(F.col("name") == "name", F.decode(F.get("b", 0), "utf-8")))
    return rows.groupBy("record").agg(name.alias("n"), F.max(F.when(F.col("name") == "key", F.get("i", 0))).alias("k")).select(F.col("n").alias("name"), "k")


@fixed("udtf01_example_features", "SELECT n_nationkey::bigint AS k, f AS feature FROM nation, (SELECT unnest(['name', 'key']) AS f)")
def udtf01(spark, sf_dir):
    tfrecord.register(spark)
    d = spark.createDataFrame([(r.n_nationkey, bytearray(example(r.n_name.encode(), r.n_nationkey))) for r in nations(spark, sf_dir)], "k bigint, data binary")
    return d.lateralJoin(tfrecord.ExampleFeatures(F.col("data").outer())).select("k", F.col("name").alias("feature"))


@fixed("src13_fetch", "SELECT page_id, page_id % 4 <> 0 AS ok FROM pages")
def src13(spark, sf_dir):
    """Retries and reasons, with a stand-in for the network."""

    def get(url: str) -> bytes:
        if int(url) % 4 == 0:
            raise ValueError("unreachable")
        return url.encode()

    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("page_id").cast("string").alias("url"))
    return fetch.fetched(d, "url", 4, get, 0.0).select("page_id", F.col("error").isNull().alias("ok"))


@fixed("src14_listing", "SELECT 'shard-' || lpad(n_nationkey::varchar, 3, '0') || '.tar' AS name FROM nation")
def src14(spark, sf_dir):
    where = folder(spark)
    for r in nations(spark, sf_dir):
        put(where, f"shard-{r.n_nationkey:03d}.tar", b"")
        put(where, f"note-{r.n_nationkey:03d}.txt", b"")
    return spark.createDataFrame([(u.rpartition("/")[2],) for u in archives.listed(where, (".tar",))], "name string")


@fixed("src17_numpy", "SELECT n_nationkey::bigint AS row, n_regionkey::double AS region FROM nation")
def src17(spark, sf_dir):
    import numpy as np

    where, out = folder(spark), io.BytesIO()
    np.savez(out, images=np.array([[r.n_regionkey] for r in nations(spark, sf_dir)], float))
    put(where, "x.npz", out.getvalue())
    return files.numpy_arrays(spark, where, ["images"]).select("row", F.get("values", 0).alias("region"))


@fixed("src19_run_logs", "SELECT r_name AS run, r_regionkey::bigint AS step FROM region")
def src19(spark, sf_dir):
    where = folder(spark)
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect():
        put(where, f"{r.r_name}.jsonl", json.dumps({"step": r.r_regionkey}).encode() + b"\n\n")
    return files.run_logs(spark, f"{where}/*.jsonl", "step bigint").select("run", "step")


@fixed("snk01_bucket_append", "SELECT event_type, count(*)::bigint AS n FROM events GROUP BY 1")
def snk01(spark, sf_dir):
    where, e = folder(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).write.mode("append").partitionBy("event_type").parquet(where)
    return spark.read.parquet(where).groupBy("event_type").agg(F.count("*").alias("n"))


@fixed("snk02_progress", "SELECT event_type AS name, count(*)::bigint AS n FROM events GROUP BY 1")
def snk02(spark, sf_dir):
    s, e = store.Store(spark, folder(spark)), spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in (0, 1):
        s.progress("events", {r.event_type: r.n for r in e.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count("*").alias("n")).collect()})
    return s.totals().select("name", "n")


@fixed("snk03_metric_log", "SELECT r_regionkey::bigint AS step FROM region UNION ALL SELECT r_regionkey + 10 FROM region")
def snk03(spark, sf_dir):
    where, r = folder(spark), spark.read.parquet(f"{sf_dir}/region.parquet")
    for k in (0, 10):
        store.log_row(r.select((F.col("r_regionkey") + k).cast("bigint").alias("step")), where)
    return spark.read.schema("step bigint").json(where)


@fixed("snk05_store_append", "SELECT lang AS bucket, count(*)::bigint AS n, count(*) FILTER (WHERE doc_id < 20)::bigint AS n_val, true AS whole FROM documents GROUP BY 1")
def snk05s(spark, sf_dir):
    """Two sources staged and merged, the third appended later; places in a bucket have no gaps."""
    s = store.Store(spark, folder(spark))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("bucket"), (F.col("doc_id") < 20).alias("val"), F.lit(0.0).alias("crop"), F.array(F.col("n_chars").cast("float")).alias("latent"), (F.col("doc_id") % 3).alias("_s"))
    for k, name in enumerate(("a", "b", "c")):
        s.stage(d.where(F.col("_s") == k).drop("_s"), name)
    s.merge(exclude=("c",))
    s.append("c")
    return s.check().select("bucket", "n", "n_val", "whole")


@fixed("stm03_resume", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def stm03(spark, sf_dir):
    """The same stream started twice: offsets in the checkpoint keep every row once (STM-03, STM-04, STM-11)."""
    schema, where = spark.read.parquet(f"{sf_dir}/events.parquet").schema, folder(spark)
    for _ in range(2):
        ingest.run(spark, f"{sf_dir}/events.parquet*", schema, where, f"{where}/checkpoint", F.col("event_type") != "error", ["event_id"], 1)
    return spark.read.schema(schema).parquet(f"{where}/rows/*").select("event_id", "event_type")


@query("joi13_all_pairs", "SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1e0 WHEN a.n_chars = b.n_chars THEN 5e-1 ELSE 0e0 END), 9) AS auroc FROM (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) a, (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0) b")
def joi13(t):
    """Every positive against every negative, from counts below each value: no pair is made."""
    d = t("documents").join(t("labels"), "doc_id").select("n_chars", "quality", F.lit(1).alias("all"))
    return E.auroc(d, "n_chars", "quality", ["all"]).select(F.round("auroc", 9).alias("auroc"))


@query("agg01_group_lists", "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def agg01(t):
    from loomspan.operators.curate import grouped_captions

    return grouped_captions(t("conversations"), "conv_id", "turn", "role").select("conv_id", F.col("captions").alias("roles"))


@query("set02_append", "SELECT doc_id, 0 AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang <> 'en'")
def set02(t):
    from loomspan.operators.curate import merged

    d = t("documents").select("doc_id", "lang")
    return merged([d.where("lang = 'en'").select("doc_id", F.lit(0).alias("part")), d.where("lang <> 'en'").select("doc_id", F.lit(1).alias("part"))])


@query("prj09_cover_box", "WITH s AS (SELECT o_orderkey, (o_custkey % 900 + 100)::double AS w, (o_orderkey % 700 + 100)::double AS h FROM orders), b AS (SELECT o_orderkey, greatest(288, round_even(w * greatest(288 / w, 224 / h), 0)::int) AS nw, greatest(224, round_even(h * greatest(288 / w, 224 / h), 0)::int) AS nh FROM s) SELECT o_orderkey, nw, nh, ((nw - 288) // 2)::int AS l, ((nh - 224) // 2)::int AS top FROM b")
def prj09(t):
    b = store.cover_box((F.col("o_custkey") % 900 + 100).cast("double"), (F.col("o_orderkey") % 700 + 100).cast("double"), 288, 224)
    return t("orders").select("o_orderkey", b.alias("b")).select("o_orderkey", F.col("b.w").alias("nw"), F.col("b.h").alias("nh"), F.col("b.left").alias("l"), "b.top")


@query("udf01_scorer", "SELECT doc_id, (length(text) + length(lang))::double AS score FROM documents")
def udf01(t):
    """The scorer contract with a stand-in model."""

    def factory():
        return lambda pictures, prompts: [len(p) + len(q) for p, q in zip(pictures, prompts, strict=True)]

    return t("documents").select("doc_id", models.scorer(factory)(F.col("text"), F.col("lang")).alias("score"))


@query("udf02_yes_probability", "SELECT event_id, round(1 / (1 + exp(ln(exp(1e0) + exp(user_id / 1e2)) - ln(exp(value / 1e2) + exp(0)))), 9) AS p FROM events")
def udf02(t):
    yes, no = F.array(F.col("value") / 100, F.lit(0.0)), F.array(F.lit(1.0), F.col("user_id") / 100)
    return t("events").select("event_id", F.round(models.yes_probability(yes, no), 9).alias("p"))


@query("agg29_by_shape", "SELECT round(avg(length(text))::double, 6) AS m FROM documents")
def agg29(t):
    """Batches of one language each go through a model contract that gives a mean a batch; then the mean over all rows."""

    def mean_length(part):
        return part.groupby("lang", as_index=False).agg(m=("n", "mean"), n=("n", "size"))

    d = t("documents").where("text is not null").select("lang", F.length("text").alias("n"))
    batches = models.by_shape(d, "lang", mean_length, "lang string, m double, n long")
    return batches.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("m"))
