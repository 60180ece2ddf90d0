"""Queries of evaluation analytics (AGG-09..24, WIN-02..05, WIN-13, WIN-14, MTH-08, MTH-09)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import numeric as N
from loomspan.functions import text as S
from loomspan.functions.hashing import u01
from loomspan.operators import evaluate as E
from loomspan.operators import gram
from loomspan.operators import orderstat as O
from loomspan.operators.scan import ranged
from loomspan.operators.tables import written

from .registry import query, u01_sql, words_sql


def auroc_sql(rows: str, by: str = "") -> str:
    """From rows (by..., score, pos)."""
    p = f"PARTITION BY {by}" if by else ""
    both = f"PARTITION BY {by + ', ' if by else ''}score"
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH d AS ({rows}), r AS (SELECT *, rank() OVER ({p} ORDER BY score) + (count(*) OVER ({both}) - 1) / 2e0 AS rk FROM d WHERE score IS NOT NULL AND NOT isnan(score::double)),
g AS (SELECT {head} sum(pos) AS np, count(*) - sum(pos) AS nn, sum(pos * rk) AS s FROM r {group})
SELECT {head} np::bigint AS n_pos, nn::bigint AS n_neg, CASE WHEN np > 0 AND nn > 0 THEN round((s - np * (np + 1) / 2) / (np * nn), 9) END AS auroc FROM g"""


def rounded(df, *columns, places=9):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("agg09_group_std", "SELECT round(avg(sd), 6) AS group_std FROM (SELECT stddev_pop(value) AS sd FROM events GROUP BY user_id HAVING count(*) >= 4)")
def agg09(t):
    e = t("events").withColumn("all", F.lit(1)).withColumn("noisy", F.col("value"))
    return rounded(E.group_snr(e, ["all"], "user_id", "value", "noisy").select("group_std"), "group_std", places=6)


@query("agg10_snr", "WITH s AS (SELECT event_type, avg(sd) AS group_std FROM (SELECT event_type, stddev_pop(value) AS sd FROM events GROUP BY event_type, user_id HAVING count(*) >= 4) GROUP BY 1), n AS (SELECT event_type, avg(abs(value - (value * 9e-1 + user_id % 7))) AS noise FROM events GROUP BY 1) SELECT event_type, round(group_std / greatest(noise, 1e-9), 6) AS snr FROM s JOIN n USING (event_type)")
def agg10(t):
    e = t("events").withColumn("noisy", F.col("value") * 0.9 + F.col("user_id") % 7)
    return rounded(E.group_snr(e, ["event_type"], "user_id", "value", "noisy").select("event_type", "snr"), "snr", places=6)


@query("agg11_auroc", auroc_sql("SELECT n_chars AS score, quality AS pos FROM documents JOIN labels USING (doc_id)"))
def agg11(t):
    d = t("documents").join(t("labels"), "doc_id").select("n_chars", "quality", F.lit(1).alias("all"))
    return rounded(E.auroc(d, "n_chars", "quality", ["all"]).drop("all"), "auroc")


DIRECTIONS = "SELECT metric, n_chars AS score, 1 - quality AS pos FROM documents JOIN labels USING (doc_id), (SELECT unnest(['artifact', 'quality']) AS metric)"


@query("agg12_directional", f"SELECT metric, round(CASE WHEN metric IN ('artifact', 'aislop') THEN auroc ELSE 1 - auroc END, 9) AS detect FROM ({auroc_sql(DIRECTIONS, 'metric')})")
def agg12(t):
    d = t("documents").join(t("labels"), "doc_id")
    m = F.explode(F.array(F.lit("artifact"), F.lit("quality"))).alias("metric")
    d = d.select(m, "n_chars", (1 - F.col("quality")).alias("bad"))
    return E.auroc(d, "n_chars", "bad", ["metric"]).select("metric", F.round(E.detection(F.col("metric"), F.col("auroc")), 9).alias("detect"))


@query("agg13_hardneg", "SELECT round(avg(CASE WHEN a.value > b.value THEN 1e0 WHEN a.value = b.value THEN 5e-1 ELSE 0e0 END), 9) AS win FROM (SELECT user_id, avg(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click'")
def agg13(t):
    own = t("events").where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("own"))
    other = t("events").where("event_type = 'click'").select("user_id", F.col("value").alias("other"))
    return own.join(other, "user_id").agg(F.round(E.win_rate(F.col("own"), F.col("other")), 9).alias("win"))


SPEARMAN = """WITH v AS (SELECT event_type AS s, user_id % 10 AS g, user_id AS i, avg(value) AS x FROM events GROUP BY ALL),
p AS (SELECT a.s AS a, b.s AS b, g, a.x AS x, b.x AS y FROM v a JOIN v b USING (g, i) WHERE a.s < b.s),
r AS (SELECT *, rank() OVER (PARTITION BY a, b, g ORDER BY x) + (count(*) OVER (PARTITION BY a, b, g, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY a, b, g ORDER BY y) + (count(*) OVER (PARTITION BY a, b, g, y) - 1) / 2e0 AS ry FROM p),
c AS (SELECT a, b, g, corr(rx, ry) AS rho FROM r GROUP BY ALL HAVING count(*) >= 6 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)
SELECT a, b, round(avg(rho), 6) AS agreement, count(*)::bigint AS n_groups FROM c WHERE NOT isnan(rho) GROUP BY ALL"""


@query("agg14_spearman", SPEARMAN)
def agg14(t):
    v = t("events").groupBy("event_type", "user_id").agg(F.avg("value").alias("x")).withColumn("g", F.col("user_id") % 10)
    return rounded(E.rank_agreement(v, "event_type", "g", "user_id", "x"), "agreement", places=6)


@query("agg15_flag_rates", f"SELECT round(avg(({words_sql('text')} > 300)::int) FILTER (WHERE quality = 1), 9) AS recall, round(avg(({words_sql('text')} > 300)::int) FILTER (WHERE quality = 0), 9) AS false_positive FROM documents JOIN labels USING (doc_id)")
def agg15(t):
    d = t("documents").join(t("labels"), "doc_id").select("quality", (S.word_count(F.col("text")) > 300).cast("int").alias("flag"))
    return d.agg(F.round(F.avg(F.when(F.col("quality") == 1, F.col("flag"))), 9).alias("recall"), F.round(F.avg(F.when(F.col("quality") == 0, F.col("flag"))), 9).alias("false_positive"))


CONTRASTS = "SELECT contrast, n_chars AS score, CASE contrast WHEN 'quality' THEN quality WHEN 'toxic' THEN toxic ELSE (lang = 'en')::int END AS pos FROM documents JOIN labels USING (doc_id), (SELECT unnest(['quality', 'toxic', 'english']) AS contrast)"


@query("agg16_auroc_table", auroc_sql(CONTRASTS, "contrast"))
def agg16(t):
    d = t("documents").join(t("labels"), "doc_id")
    c = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("quality", "toxic", "english"))), F.array(F.col("quality").cast("int"), F.col("toxic").cast("int"), (F.col("lang") == "en").cast("int")))).alias("contrast", "pos")
    return rounded(E.auroc(d.select("n_chars", c), "n_chars", "pos", ["contrast"]), "auroc")


@query("agg17_survey", f"WITH w AS (SELECT source, n_chars, {words_sql('text')} AS n FROM documents) SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS side_med, min(n_chars) AS side_min, floor(quantile_cont(n, 5e-1))::bigint AS words_med, round(100e0 * avg((n * 135e-2 > 64)::int), 4) AS over_pct FROM w GROUP BY 1")
def agg17(t):
    """Both medians by refinement: no source's values meet on one task."""
    d = t("documents").select("source", "n_chars", S.word_count(F.col("text")).alias("words"), S.over_limit(F.col("text")).cast("int").alias("over"))
    side = O.at_ranks(d, ["source"], "n_chars", F.array(F.floor(F.col("n") / 2).cast("long"))).select(F.col("source").alias("s1"), F.col("value").cast("bigint").alias("side_med"))
    words = O.quantiles(d, ["source"], "words", {"m": 0.5}).select(F.col("source").alias("s2"), F.floor("m").cast("bigint").alias("words_med"))
    d = d.groupBy("source").agg(F.min("n_chars").alias("side_min"), F.round(F.lit(100.0) * F.avg("over"), 4).alias("over_pct"))
    d = d.join(side, F.col("source").eqNullSafe(F.col("s1"))).join(words, F.col("source").eqNullSafe(F.col("s2")))
    return d.select("source", "side_med", "side_min", "words_med", "over_pct")


@query("agg18_frechet_parts", "WITH x AS (SELECT label, vec_id, i, embedding[i + 1]::double AS x FROM embeddings, (SELECT unnest(range(64)) AS i)) SELECT a.label, a.i::int AS i, b.i::int AS j, round(covar_samp(a.x, b.x), 6) AS cov, round(avg(a.x), 6) AS mean_i FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL")
def agg18p(t):
    return rounded(gram.moments(t("embeddings"), ["label"], "embedding").select("label", "i", "j", "cov", "mean_i"), "cov", "mean_i", places=6)


@query("agg18_frechet")
def agg18(t):
    """Distance of labels 0 and 1 over all dimensions: d x d numbers a group come to the driver."""
    m = gram.matrices(t("embeddings").where("label in (0, 1)").select("label", "embedding"), ["label"], "embedding")
    value = E.frechet(m[0,][1:], m[1,][1:])
    return t("embeddings").sparkSession.createDataFrame([(value,)], "frechet double")


PASSES = "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS c FROM events GROUP BY 1"
PASS4 = "CASE WHEN n - c < 4 THEN 1e0 ELSE 1 - ((n - c) * (n - c - 1) * (n - c - 2) * (n - c - 3))::double / (n * (n - 1) * (n - 2) * (n - 3)) END"


def passes(t, least=1):
    """n and c of each user over all events; users with fewer than `least` have no pass@least."""
    e = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("c"))
    return e.where(F.col("n") >= least)


@query("agg19_passk", f"SELECT user_id, round({PASS4}, 9) AS p4 FROM ({PASSES}) WHERE n >= 4")
def agg19(t):
    return passes(t, 4).select("user_id", F.round(E.pass_at(F.col("c"), F.col("n"), 4), 9).alias("p4"))


@query("agg19_passk_families", f"SELECT (user_id % 3)::bigint AS family, round(avg({PASS4}), 9) AS p4 FROM ({PASSES}) WHERE n >= 4 GROUP BY 1")
def agg19f(t):
    return passes(t, 4).groupBy((F.col("user_id") % 3).alias("family")).agg(F.round(F.avg(E.pass_at(F.col("c"), F.col("n"), 4)), 9).alias("p4"))


@query("agg20_softbest", "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(value * (3e0 * i * (i - 1) / (n * (n - 1e0) * (n - 2e0)))), 6) AS soft3 FROM s WHERE n >= 3 GROUP BY 1")
def agg20(t):
    """Weights C(i, 2) / C(n, 3) by each user's own n."""
    w = Window.partitionBy("user_id")
    e = t("events").withColumn("i", (F.row_number().over(w.orderBy("value")) - 1).cast("double")).withColumn("n", F.count("*").over(w).cast("double")).where("n >= 3")
    weight = 3 * F.col("i") * (F.col("i") - 1) / (F.col("n") * (F.col("n") - 1) * (F.col("n") - 2))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("soft3"))


@query("agg21_counts", f"SELECT count(*) FILTER (WHERE c = 0)::bigint AS n_zero, count(*) FILTER (WHERE c = n)::bigint AS n_all, round(avg(c / n::double), 9) AS mean_p FROM ({PASSES})")
def agg21(t):
    return passes(t).agg(F.count_if(F.col("c") == 0).alias("n_zero"), F.count_if(F.col("c") == F.col("n")).alias("n_all"), F.round(F.avg(F.col("c") / F.col("n")), 9).alias("mean_p"))


HITS = "SELECT user_id, count(*) FILTER (WHERE value > 60 AND event_id % 2 = 0) AS b, count(*) FILTER (WHERE value > 60 AND event_id % 2 = 1) AS a FROM events GROUP BY 1"


def hits(t):
    hit = lambda odd: F.count_if((F.col("value") > 60) & (F.col("event_id") % 2 == odd))
    return t("events").groupBy("user_id").agg(hit(0).alias("b"), hit(1).alias("a"))


@query("agg22_newly_lost", f"SELECT count(*) FILTER (WHERE b = 0 AND a > 0)::bigint AS newly, count(*) FILTER (WHERE b > 0 AND a = 0)::bigint AS lost FROM ({HITS})")
def agg22(t):
    return hits(t).agg(F.count_if((F.col("b") == 0) & (F.col("a") > 0)).alias("newly"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("lost"))


@query("agg22_newly_lost_users", f"SELECT user_id, CASE WHEN b = 0 THEN 'newly' ELSE 'lost' END AS status FROM ({HITS}) WHERE (b = 0) <> (a = 0)")
def agg22u(t):
    """The users themselves."""
    status = F.when((F.col("b") == 0) & (F.col("a") > 0), "newly").when((F.col("b") > 0) & (F.col("a") == 0), "lost")
    return hits(t).select("user_id", status.alias("status")).where("status is not null")


#: Gain of each user: the mean of the events with even ids less that of the others.
GAIN = "SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 = 1) AS gain FROM events GROUP BY 1"


def gains(t):
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    return t("events").groupBy("user_id").agg((side(0) - side(1)).alias("gain")).where("gain is not null")


#: Users that one row of a resample draws for; users up to which their gains are broadcast (16 bytes each).
DRAWN, SENT_USERS = 8_192, 1 << 20


@query("agg23_bootstrap", f"WITH p AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, gain, count(*) OVER () AS n FROM ({GAIN}) WHERE gain IS NOT NULL), d AS (SELECT b, floor({u01_sql('b || chr(47) || j')} * n)::int AS i FROM (SELECT unnest(range(1000)) AS b), (SELECT i AS j, n FROM p)), m AS (SELECT b, avg(gain) AS g FROM d JOIN p USING (i) GROUP BY 1) SELECT round(quantile_cont(g, 25e-3), 6) AS lo, round(quantile_cont(g, 975e-3), 6) AS hi FROM m")
def agg23(t):
    """1,000 resamples of all paired users, drawn by hash so that any engine draws the same."""
    p = written(ranged(written(gains(t)), [], "user_id").running(i=("count", None)).rows().select((F.col("i") - 1).alias("i"), "gain"))
    n = p.count()
    blocks = -(-n // DRAWN)
    # A row a resample and block of users, some a task, so that tasks keep their size and partial means are few.
    d = p.sparkSession.range(0, 1000 * blocks, 1, max(1, -(-1000 * blocks // 128))).select(F.expr(f"id div {max(1, blocks)}").alias("b"), F.expr(f"id % {max(1, blocks)}").alias("k"))
    d = d.select("b", F.explode(F.sequence(F.col("k") * DRAWN, F.least(F.lit(n), (F.col("k") + 1) * DRAWN) - 1)).alias("j"))
    d = d.select("b", F.floor(u01(F.concat_ws("/", F.col("b").cast("string"), F.col("j").cast("string"))) * F.lit(n)).alias("i"))
    # 1,000 draws a user would be sorted and shuffled; the users, two numbers each, go to the draws as long as they are small.
    m = d.join(F.broadcast(p) if n <= SENT_USERS else p.hint("merge"), "i").groupBy("b").agg(F.avg("gain").alias("g"))
    return O.quantiles(m, [], "g", {"lo": 0.025, "hi": 0.975}).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("agg23_bootstrap_weights")
def agg23w(t):
    """10,000 resamples of the same pairs as weights: users are read once, and a task sends one sum a resample."""
    m = O.bootstrap(gains(t), "user_id", "gain", 10_000)
    return O.quantiles(m, [], "mean", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).select(*[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


@query("agg24_object_acc", "WITH d AS (SELECT user_id, list(event_type) FILTER (WHERE value >= 50) AS found FROM events GROUP BY 1) SELECT round(avg((list_contains(coalesce(found, []), CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END))::int), 9) AS accuracy FROM d")
def agg24(t):
    d = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("found"))
    wanted = F.when(F.col("user_id") % 2 == 0, "view").otherwise("click")
    return d.agg(F.round(F.avg(F.array_contains("found", wanted).cast("int")), 9).alias("accuracy"))


@query("win02_advantage", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / ((SELECT stddev_samp(value) FROM events) + 1e-4), 6) AS a FROM events")
def win02(t):
    return E.group_advantage(t("events"), "value", "user_id").select("event_id", F.round("advantage", 6).alias("a"))


TERMS = "SELECT event_id, user_id, value AS align, (value * 7 + user_id) % 11 AS real, -((event_id % 5))::double AS style, (event_id % 97 = 0)::int AS veto FROM events"
TERM_SQL = f"WITH x AS ({TERMS}), a AS (SELECT *, style - avg(style) OVER g AS a_style, 4e-1 * (align - avg(align) OVER g) / ((SELECT stddev_pop(align) FROM x) + 1e-4) + 3e-1 * (real - avg(real) OVER g) / ((SELECT stddev_pop(real) FROM x) + 1e-4) + 15e-2 * (style - avg(style) OVER g) AS adv FROM x WINDOW g AS (PARTITION BY user_id))"


def terms(t):
    e = t("events").select("event_id", "user_id", F.col("value").alias("align"), ((F.col("value") * 7 + F.col("user_id")) % 11).alias("real"), (-(F.col("event_id") % 5)).cast("double").alias("style"), (F.col("event_id") % 97 == 0).cast("int").alias("veto"))
    return E.combined_advantage(e, "user_id", {"align": 0.4, "real": 0.3, "style": 0.15}, "veto")


@query("win03_multi_adv", f"{TERM_SQL} SELECT event_id, round(a_style, 6) AS a_style, round(adv, 6) AS adv FROM a WHERE veto = 0")
def win03(t):
    return terms(t).select("event_id", "veto", F.round("a_style", 6).alias("a_style"), F.round("advantage", 6).alias("adv")).where("veto = 0").drop("veto")


@query("win04_veto", f"{TERM_SQL} SELECT event_id, round(CASE WHEN veto > 0 THEN least(min(adv) OVER (PARTITION BY user_id), -2) ELSE adv END, 6) AS adv FROM a")
def win04(t):
    return terms(t).select("event_id", F.round("advantage", 6).alias("adv"))


@query("win05_permuted", "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY md5('p' || event_id), event_id) AS r FROM events) SELECT event_id, value FROM a JOIN b USING (user_id, r)")
def win05(t):
    w = Window.partitionBy("user_id")
    a = t("events").select("user_id", "event_id", F.row_number().over(w.orderBy("event_id")).alias("r"))
    b = t("events").select("user_id", "value", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("p"), F.col("event_id").cast("string"))), "event_id")).alias("r"))
    return a.join(b, ["user_id", "r"]).select("event_id", "value")


@query("win13_order_stats", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)::int AS rank FROM events")
def win13(t):
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("rank"))


@query("win14_deviation", "SELECT event_id, round(-(greatest((value - 80) / 10, 0) + greatest((20 - value) / 10, 0)), 6) AS style FROM events")
def win14(t):
    return t("events").select("event_id", F.round(E.style_penalty({"value": (20.0, 80.0, 10.0)}), 6).alias("style"))


@query("mth08_gate", "SELECT user_id, round(sum(value * 1e-3 * (event_id % 10 - 45e-1)) / 8, 6) AS margin, round(1 / (1 + exp(-sum(value * 1e-3 * (event_id % 10 - 45e-1)) / 8)), 6) AS gate FROM events GROUP BY 1")
def mth08(t):
    e = t("events").select("user_id", F.col("value").alias("adv"), (F.col("event_id") % 10).cast("double").alias("dsm"), F.lit(4.5).alias("ref_dsm"))
    return rounded(E.preference_gate(e, "user_id", 1e-3, 8), "margin", "gate", places=6)


@query("mth09_ppo", "WITH a AS (SELECT event_id, greatest(-5, least(5, value / 10 - 5)) AS a, 5e-1 + user_id % 10 / 1e1 AS r FROM events) SELECT event_id, round(greatest(-a * r, -a * greatest(8e-1, least(12e-1, r))), 9) AS loss FROM a")
def mth09(t):
    return t("events").select("event_id", F.round(N.clipped_policy_loss(F.col("value") / 10 - 5, F.lit(0.5) + F.col("user_id") % 10 / F.lit(10.0), 0.2), 9).alias("loss"))
