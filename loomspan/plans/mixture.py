"""Queries of hold-out, mixture, merge, append and sampling (WIN-01, AGG-02..06, AGG-32, SNK, SRT)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import numeric as N
from loomspan.functions.hashing import u01
from loomspan.operators import curate as C
from loomspan.operators import sampling as P

from .curation import DOUBLE_RATIO, bucket_sql
from .registry import query, u01_sql

# The final mix.
WEIGHTS = [("A", 0.60), ("N", 0.25), ("R", 0.15)]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
KEY = "'real' || l_orderkey || '-' || l_linenumber"
def holdout_sql(n: int) -> str:
    return f"""r AS (SELECT l_returnflag AS source, {bucket_sql(DOUBLE_RATIO, KEY)} AS bucket, {', '.join(ORDER)} FROM lineitem),
h AS (SELECT source, bucket, row_number() OVER (PARTITION BY source ORDER BY {', '.join(ORDER)}) <= {n} AS val FROM r WHERE bucket IS NOT NULL)"""
MIX = ", c AS (SELECT source, bucket, count(*)::bigint AS n FROM h WHERE NOT val GROUP BY ALL), w AS (SELECT * FROM (VALUES ('A', 6e-1), ('N', 25e-2), ('R', 15e-2)) v(source, weight) WHERE source IN (SELECT source FROM c)), j AS (SELECT source, bucket, n, weight / (SELECT sum(weight) FROM w) * n / sum(n) OVER (PARTITION BY source) AS joint FROM c JOIN w USING (source)), p AS (SELECT source, bucket, n, sum(joint) OVER (PARTITION BY bucket) AS p_b, joint / sum(joint) OVER (PARTITION BY bucket) AS p_s FROM j)"


def rows(t):
    key = F.concat(F.lit("real"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    aspect = F.col("l_quantity") / (1 + F.col("l_partkey") % 50).cast("double")
    return t("lineitem").select(F.col("l_returnflag").alias("source"), C.bucket(aspect, True, key)["bucket"].alias("bucket"), *ORDER).where("bucket is not null")


def probabilities(t, n_val: int):
    counts = C.held_out(rows(t), "source", ORDER, n_val).where("not val").groupBy("source", "bucket").agg(F.count("*").alias("n"))
    weights = counts.sparkSession.createDataFrame(WEIGHTS, "source string, weight double")
    return C.mixture(counts, weights)


def bucket_mix(t, n_val: int = C.HOLD_OUT):
    """FLT-01, PRJ-06, WIN-01, AGG-02, AGG-32 in one: P(bucket) and P(source | bucket) of the training rows."""
    return probabilities(t, n_val).select("source", "bucket", "n", F.round("p_b", 9).alias("p_b"), F.round("p_s_given_b", 9).alias("p_s_given_b"))


query("bucket_mix", f"WITH {holdout_sql(1000)} {MIX} SELECT source, bucket, n, round(p_b, 9) AS p_b, round(p_s, 9) AS p_s_given_b FROM p")(bucket_mix)


@query("agg32_mixture", f"WITH {holdout_sql(100)} {MIX} SELECT bucket, round(sum(joint), 9) AS p_b FROM j GROUP BY 1")
def agg32(t):
    return probabilities(t, 100).select("bucket", F.round("p_b", 9).alias("p_b")).distinct()


@query("win01_holdout", f"WITH {holdout_sql(1000)} SELECT source, bucket, count(*) FILTER (WHERE val)::bigint AS n_val, count(*)::bigint AS n FROM h GROUP BY ALL")
def win01(t):
    return C.held_out(rows(t), "source", ORDER).groupBy("source", "bucket").agg(F.count_if("val").alias("n_val"), F.count("*").alias("n"))


@query("agg02_matrix", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}')::bigint AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1")
def agg02(t):
    langs = ["de", "en", "es", "fr"]
    return t("documents").groupBy("source").pivot("lang", langs).count().na.fill(0, langs)


@query("agg04_channel_stats", "WITH x AS (SELECT unnest(range(64))::int AS channel, unnest(embedding)::double AS x FROM embeddings) SELECT channel, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)), 6) AS std FROM x GROUP BY 1")
def agg04(t):
    return C.channel_stats(t("embeddings"), "embedding").select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SAMPLE_SQL = "k AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY md5('s' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM embeddings), s AS (SELECT * FROM k WHERE r <= least(n, greatest(1, (200 * n) // greatest(1, total * 1))))"


@query("agg05_sampled_stats", f"WITH {SAMPLE_SQL} SELECT label, count(*)::bigint AS k FROM s GROUP BY 1")
def agg05(t):
    """Rows for the statistics: a share of each group by hash, one row at least."""
    e = t("embeddings")
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total)).withColumn("k", F.least("n", F.greatest(F.lit(1), F.expr("200 * n div greatest(1, total)"))))
    return P.per_group(e.join(F.broadcast(sizes), "label"), ["label"], "s", "vec_id", F.col("k"), 200).groupBy("label").agg(F.count("*").alias("k"))


@query("agg06_sources", "SELECT DISTINCT source FROM documents")
def agg06(t):
    return t("documents").select("source").distinct()


@query("agg07_line_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::bigint AS n FROM documents")
def agg07(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n"))


@query("mth11_whiten", "WITH x AS (SELECT vec_id, unnest(range(64)) AS c, unnest(embedding)::double AS x FROM embeddings), s AS (SELECT c, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)) AS sd FROM x GROUP BY 1) SELECT vec_id, round(sum((x - m) / sd), 4) AS total FROM x JOIN s USING (c) GROUP BY 1")
def mth11(t):
    stats = C.channel_stats(t("embeddings"), "embedding").agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("s"))
    e = t("embeddings").crossJoin(F.broadcast(stats))
    z = N.whiten(F.col("embedding"), F.transform("s", lambda x: x["mean"]), F.transform("s", lambda x: x["std"]))
    return e.select("vec_id", F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("win12_address", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id)::int AS row_no FROM documents")
def win12(t):
    d = P.ordinals(t("documents").select("doc_id", "lang", "source"), ["lang"], ["source"], "doc_id", "row_no")
    return d.select("doc_id", "lang", F.col("row_no").cast("int").alias("row_no"))


@query("srt01_sorted", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey)::int AS pos FROM nation")
def srt01(t):
    return t("nation").select("n_nationkey", F.row_number().over(Window.orderBy("n_nationkey")).alias("pos"))


@query("srt02_split_rank", "SELECT page_id, CASE WHEN contains(url, 'train') THEN 0 WHEN contains(url, 'val') THEN 1 WHEN contains(url, 'test') THEN 2 ELSE 3 END AS r FROM pages")
def srt02(t):
    return t("pages").select("page_id", P.split_rank(F.col("url")).alias("r"))


@query("srt03_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def srt03(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("srt04_stride", "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) WHERE r % 3 = 0 AND r < 3 * 20")
def srt04(t):
    return P.strided(t("supplier").select("s_suppkey"), "s_suppkey", 3, 20)


@query("srt05_target", "SELECT doc_id FROM documents WHERE n_chars > 500 ORDER BY doc_id LIMIT 50")
def srt05(t):
    return t("documents").where("n_chars > 500").select("doc_id").orderBy("doc_id").limit(50)


@query("srt06_shuffle", "SELECT doc_id FROM documents ORDER BY md5('7' || doc_id), doc_id LIMIT 64")
def srt06(t):
    return P.shuffled_take(t("documents").select("doc_id"), "7", "doc_id", 64)


@query("srt07_failures", "SELECT CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN quality = 0 THEN 'bad' ELSE 'ok' END AS reason, count(*)::bigint AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def srt07(t):
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return d.groupBy(F.when(F.col("quality").isNull(), "no label").when(F.col("quality") == 0, "bad").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("srt08_per_bucket", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('v' || doc_id), doc_id) AS r FROM documents) WHERE r <= 16")
def srt08(t):
    return P.per_group(t("documents").select("lang", "doc_id"), ["lang"], "v", "doc_id", 16)


@query("srt09_stratified", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0' || doc_id), doc_id) AS r FROM documents) WHERE r <= 100 // (SELECT count(DISTINCT source) FROM documents)")
def srt09(t):
    d = t("documents").select("source", "doc_id")
    per = d.agg(F.floor(F.lit(100) / F.countDistinct("source")).alias("per"))
    return P.per_group(d.crossJoin(F.broadcast(per)), ["source"], "0", "doc_id", F.col("per"), 100).select("source", "doc_id")


@query("srt10_smallest", "SELECT user_id FROM events GROUP BY 1 ORDER BY round(avg(value), 9), user_id LIMIT 8")
def srt10(t):
    return t("events").groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("m")).orderBy("m", "user_id").limit(8).select("user_id")


@query("srt11_display", "SELECT n_nationkey, coalesce(list_position(['CHINA', 'JAPAN'], n_name), 99)::int AS place FROM nation")
def srt11(t):
    p = F.array_position(F.array(F.lit("CHINA"), F.lit("JAPAN")), F.col("n_name"))
    return t("nation").select("n_nationkey", F.when(p > 0, p).otherwise(99).cast("int").alias("place"))


@query("srt12_chunks", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64)::bigint AS chunk FROM documents")
def srt12(t):
    return P.chunks(t("documents").select("doc_id", "lang"), ["lang"], "doc_id", 64).select("doc_id", "chunk")


@query("srt13_sampler", f"WITH {holdout_sql(100)} {MIX}, f AS (SELECT source, bucket, sum(p_s) OVER (PARTITION BY bucket ORDER BY source) AS upto, p_s FROM p), d AS (SELECT event_id AS draw, ['1_1', '4_3', '3_4', '3_2', '2_3'][(1 + event_id % 5)::int] AS bucket, {u01_sql(chr(39) + 'b' + chr(39) + ' || event_id')} AS u FROM events) SELECT draw, d.bucket, source FROM d JOIN f ON d.bucket = f.bucket AND u >= upto - p_s AND u < upto")
def srt13(t):
    names = F.array(*[F.lit(b) for b in C.BUCKETS])
    draws = t("events").select(F.col("event_id").alias("draw"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("bucket"))
    return P.weighted_source(draws, probabilities(t, 100), "b").select("draw", "bucket", "source")


@query("srt13_captions", f"SELECT conv_id, CASE WHEN {u01_sql(chr(39) + 'c' + chr(39) + ' || conv_id')} < 1e-1 THEN '' WHEN {u01_sql(chr(39) + 'c' + chr(39) + ' || conv_id')} < 6e-1 THEN max(text) ELSE min(text) END AS caption FROM conversations GROUP BY 1")
def srt13c(t):
    u = u01(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    g = t("conversations").groupBy("conv_id").agg(F.max("text").alias("hi"), F.min("text").alias("lo"))
    return g.select("conv_id", F.when(u < 0.1, "").when(u < 0.6, F.col("hi")).otherwise(F.col("lo")).alias("caption"))


@query("srt14_latest", "SELECT event_type, max(ts::varchar) AS latest FROM events GROUP BY 1")
def srt14(t):
    return t("events").groupBy("event_type").agg(F.max("ts").alias("m")).select("event_type", F.regexp_replace(F.date_format("m", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("latest"))


@query("srt15_repeat", "SELECT item_id, g FROM (SELECT item_id FROM benchmark ORDER BY md5('3' || item_id), item_id LIMIT 8), (SELECT unnest(range(4))::int AS g)")
def srt15(t):
    return P.shuffled_take(t("benchmark").select("item_id"), "3", "item_id", 8).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))


@query("srt16_mismatch", "WITH o AS (SELECT n_nationkey, n_regionkey, lead(n_regionkey, 1) OVER w AS a, lead(n_regionkey, 2) OVER w AS b, first_value(n_regionkey) OVER (ORDER BY md5('5' || n_nationkey), n_nationkey) AS f FROM nation WINDOW w AS (ORDER BY md5('5' || n_nationkey), n_nationkey)) SELECT n_nationkey, coalesce(CASE WHEN a <> n_regionkey THEN a ELSE b END, f) AS other FROM o")
def srt16(t):
    return P.mismatched(t("nation"), "n_nationkey", "n_regionkey", "5").select("n_nationkey", "other")


@query("snk04_merge", "SELECT source, lang, count(*)::bigint AS n, min(seq)::int AS first FROM (SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS seq FROM documents WHERE source <> 'src3') GROUP BY ALL")
def snk04(t):
    parts = [t("documents").where(F.col("source") == s) for s in ("src0", "src1")] + [t("documents").where(~F.col("source").isin("src0", "src1", "src3"))]
    m = P.ordinals(C.merged(parts).select("doc_id", "lang", "source"), ["lang"], ["source"], "doc_id", "seq")
    return m.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("seq").cast("int").alias("first"))


@query("snk05_append", "SELECT doc_id, doc_id % 2 = 1 AS appended FROM documents")
def snk05(t):
    old, new = t("documents").where("doc_id % 2 = 0").select("doc_id", F.lit(False).alias("appended")), t("documents").where("doc_id % 2 = 1").select("doc_id", F.lit(True).alias("appended"))
    return C.merged([old, new])


@query("snk06_documents", "SELECT doc_id, '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS j FROM documents")
def snk06(t):
    return t("documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")).alias("j"))


@query("snk08_upsert", "SELECT doc_id, quality, 'old' AS src FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 - quality, 'new' FROM labels WHERE doc_id % 3 = 0")
def snk08(t):
    old = t("labels").select("doc_id", "quality", F.lit("old").alias("src"))
    new = t("labels").where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).cast(old.schema["quality"].dataType).alias("quality"), F.lit("new").alias("src"))
    return C.upserted(old, new, "doc_id")


@query("snk09_update", "SELECT event_id, CASE WHEN event_id % 10 = 0 AND event_type = 'view' THEN -1e0 ELSE value END AS value FROM events")
def snk09(t):
    e = t("events").select("event_id", "event_type", "value")
    side = e.where("event_id % 10 = 0 and event_type = 'view'").select("event_id", F.lit(-1.0).alias("value"))
    return C.overwritten(e.select("event_id", "value"), side, "event_id", ["value"])
