"""Queries of the run ledger (AGG-03, AGG-07, AGG-25..31, AGG-33..36, WIN-06..11, FLT-11)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import numeric as N
from loomspan.operators import curate as C
from loomspan.operators import ledger as L

from .registry import query


@query("agg03_source_means", "SELECT event_type, round(avg(value), 6) AS m, count(*)::bigint AS n FROM events GROUP BY ROLLUP (event_type)")
def agg03(t):
    """Means per source and over all rows (not the mean of means) in one pass."""
    return t("events").rollup("event_type").agg(F.round(F.avg("value"), 6).alias("m"), F.count("*").alias("n"))


@query("agg08_histogram", "SELECT b.bin::int AS bin, count(n)::bigint AS prompts FROM (SELECT unnest(range(61)) AS bin) b LEFT JOIN (SELECT user_id, least(60, count(*)) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) c ON b.bin = c.n GROUP BY 1")
def agg08(t):
    c = t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.least(F.lit(60), F.count("*")).alias("bin")).groupBy("bin").agg(F.count("*").alias("prompts"))
    return t("events").sparkSession.range(61).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(c.withColumn("bin", F.col("bin").cast("int"))), "bin", "left").na.fill(0, ["prompts"])


@query("agg08_top", "SELECT source, count(*)::bigint AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 6")
def agg08t(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(6)


@query("agg25_edges", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS z FROM events) SELECT event_type, round(avg(value) FILTER (WHERE a <= 10), 6) AS first10, round(avg(value) FILTER (WHERE z <= 10), 6) AS last10 FROM r GROUP BY 1")
def agg25(t):
    e = L.edges(t("events"), "event_type", "event_id")
    return e.groupBy("event_type").agg(F.round(L.mean_where("value", F.col("is_first")), 6).alias("first10"), F.round(L.mean_where("value", F.col("is_last")), 6).alias("last10"))


@query("agg26_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def agg26(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("agg27_pick", "SELECT event_type, arg_min(event_id, {'a': abs(ln(greatest(value, 1e-4)) - ln(25e-2)), 'b': event_id}) AS pick FROM events GROUP BY 1")
def agg27(t):
    far = F.abs(F.log(F.greatest("value", F.lit(1e-4))) - F.log(F.lit(0.25)))
    return t("events").groupBy("event_type").agg(L.first_best(far, F.col("event_id"), F.col("event_id")).alias("pick"))


@query("agg27_extrapolate", "SELECT event_type, (floor(least(5000, greatest(300, 100 * ln(3) / greatest(abs(avg(value)), 1e-6))) / 100 + 5e-1) * 100)::bigint AS beta FROM events GROUP BY 1")
def agg27x(t):
    b = F.least(F.lit(5000.0), F.greatest(F.lit(300.0), F.lit(100.0) * F.log(F.lit(3.0)) / F.greatest(F.abs(F.avg("value")), F.lit(1e-6))))
    return t("events").groupBy("event_type").agg((F.floor(b / 100 + 0.5) * 100).cast("bigint").alias("beta"))


@query("agg28_bins", "SELECT event_id // 500 AS bin, round(avg(value), 6) AS m FROM events GROUP BY 1")
def agg28(t):
    return t("events").groupBy(L.fixed_bin(F.col("event_id"), 500).alias("bin")).agg(F.round(F.avg("value"), 6).alias("m"))


@query("agg30_count_window", "SELECT floor((event_id - 1) / 50e0)::bigint AS w, round(avg(value), 6) AS loss, count(*)::bigint AS n FROM events GROUP BY 1")
def agg30(t):
    return t("events").groupBy(L.count_window(F.col("event_id"), 50).alias("w")).agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").alias("n"))


@query("agg31_cond_mean", "SELECT event_id // 1000 AS w, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS lo, round(avg(value) FILTER (WHERE user_id < 0), 6) AS none FROM events GROUP BY 1")
def agg31(t):
    return t("events").groupBy(L.fixed_bin(F.col("event_id"), 1000).alias("w")).agg(F.round(L.mean_where("value", F.col("user_id") % 2 == 0), 6).alias("lo"), F.round(L.mean_where("value", F.col("user_id") < 0), 6).alias("none"))


@query("agg33_coverage", "SELECT count(*)::bigint AS n, count(l.doc_id)::bigint AS hits, round(100e0 * count(l.doc_id) / count(*), 4) AS pct FROM documents d LEFT JOIN labels l USING (doc_id)")
def agg33(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.agg(F.count("*").alias("n"), F.count("quality").alias("hits"), F.round(F.lit(100.0) * F.count("quality") / F.count("*"), 4).alias("pct"))


@query("agg34_rate", "SELECT event_type, round(count(*) / greatest(date_diff('second', min(ts), max(ts))::double, 1e-6), 9) AS per_s FROM events GROUP BY 1")
def agg34(t):
    s = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    return t("events").groupBy("event_type").agg(F.round(F.count("*") / F.greatest(s.cast("double"), F.lit(1e-6)), 9).alias("per_s"))


@query("agg35_gate_spread", "SELECT user_id, round(avg((value < 10)::int), 9) AS lo, round(avg((value > 90)::int), 9) AS hi, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1")
def agg35(t):
    return t("events").groupBy("user_id").agg(F.round(F.avg((F.col("value") < 10).cast("int")), 9).alias("lo"), F.round(F.avg((F.col("value") > 90).cast("int")), 9).alias("hi"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


@query("agg36_projection", "SELECT round(sum(n_chars) / 4e0 / 1e6, 6) AS mtokens, round(sum(n_chars) / 4e0 / 1e5 / 86400, 9) AS days FROM documents")
def agg36(t):
    tokens = F.sum("n_chars") / F.lit(4.0)
    return t("documents").agg(F.round(tokens / 1e6, 6).alias("mtokens"), F.round(tokens / 1e5 / 86400, 9).alias("days"))


@query("win06_last_per_key", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def win06(t):
    return C.last_wins(t("events"), ["user_id", "event_type"], F.col("event_id")).select("user_id", "event_type", "value")


@query("win07_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::int AS r FROM events")
def win07(t):
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("r"))


EARLY = """SELECT event_id, best, sum(bad::int) OVER (PARTITION BY event_type, island ORDER BY event_id)::bigint AS bad FROM (
SELECT *, sum(1 - bad::int) OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM (
SELECT *, value > best * 1015e-3 AS bad FROM (SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type ORDER BY event_id) AS best FROM events)))"""


@query("win08_early_stop", EARLY)
def win08(t):
    return L.early_stop(t("events").select("event_id", "event_type", "value"), "event_type", "event_id", "value", 1.015).select("event_id", "best", "bad")


@query("win09_ema", """WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
e AS (SELECT event_type, r, value AS s FROM o WHERE r = 1 UNION ALL SELECT o.event_type, o.r, e.s + (o.value - e.s) * (1 - least(999e-3, (1 + (o.r - 1)) / (10e0 + (o.r - 1)))) FROM e JOIN o ON o.event_type = e.event_type AND o.r = e.r + 1)
SELECT event_type, round(arg_max(s, r), 6) AS ema FROM e GROUP BY 1""")
def win09(t):
    """Every step of the ledger: steps are affine, so blocks of them compose."""
    return L.ema_whole(t("events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 0.999).select("event_type", F.round("ema", 6).alias("ema"))


@query("win10_downsample", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT event_type, n, unnest(range(80)) AS point FROM (SELECT DISTINCT event_type, n FROM r)) SELECT p.event_type, point::int AS point, event_id FROM p JOIN r ON r.event_type = p.event_type AND r.i = round_even(point * (p.n - 1) / 79e0, 0)")
def win10(t):
    return L.even_sample(t("events").select("event_type", "event_id"), "event_type", "event_id", 80).select("event_type", "point", "event_id")


@query("win11_cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def win11(t):
    d = L.cumulative(t("events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", "total")
    return d.select("event_id", F.round("total", 4).alias("total"))


@query("flt11_relative", "WITH b AS (SELECT *, value <= 40 + 1e-2 AS ok, max((value <= 40 + 1e-2)::int) OVER (PARTITION BY user_id) = 1 AS found FROM events), c AS (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS low FROM b WHERE ok OR NOT found) SELECT event_id FROM c WHERE event_id <= 101e-2 * low")
def flt11(t):
    return L.near_baseline(t("events").withColumn("base", F.lit(40.0)), "user_id", "value", "base", "event_id").select("event_id")


@query("mth10_learning_rate", "SELECT event_id, round(1e-4 * least(1, (event_id + 1) / 100e0) * CASE WHEN event_id >= 800 THEN greatest(0, (1000 - event_id) / 200e0) ELSE 1 END, 12) AS lr FROM events")
def mth10(t):
    return t("events").select("event_id", F.round(N.learning_rate(F.col("event_id"), 1e-4, 100, 1000, 800), 12).alias("lr"))


@query("mth12_traffic_light", "SELECT event_id, CASE WHEN value >= 70 THEN 'good' WHEN value <= 20 THEN 'bad' ELSE 'mid' END AS light FROM events")
def mth12(t):
    return t("events").select("event_id", N.traffic_light(F.col("value"), 20, 70).alias("light"))


@query("mth13_clamp", "SELECT l_orderkey, (greatest(64, least(512, l_partkey)) // 16 * 16)::bigint AS w FROM lineitem")
def mth13(t):
    return t("lineitem").select("l_orderkey", N.clamp_multiple(F.col("l_partkey"), 16, 64, 512).alias("w"))


@query("mth17_round", "SELECT event_id, round(value, 4) AS v FROM events")
def mth17(t):
    return t("events").select("event_id", F.round("value", 4).alias("v"))


@query("map02_record", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view')::bigint AS n_view, count(*) FILTER (WHERE event_type = 'click')::bigint AS n_click FROM events GROUP BY 1")
def map02(t):
    m = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", *[N.get_or(F.col("m"), k, F.lit(0)).cast("bigint").alias(f"n_{k}") for k in ("view", "click")])
