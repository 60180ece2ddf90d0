"""Queries of vector and schedule functions (MTH-01..07, MTH-15, MTH-16, SRC-16, UDF-05)."""

from pyspark.sql import functions as F

from loomspan.functions import numeric as N
from loomspan.operators import gram, nearest, probe

from .registry import query


@query("src16_vectors", "SELECT vec_id, len(embedding)::bigint AS n, embedding[1]::double AS first FROM embeddings WHERE label = 3")
def src16(t):
    return t("embeddings").where("label = 3").select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.get("embedding", 0).cast("double").alias("first"))


@query("mth01_schedule", "SELECT n_nationkey, i::int AS i, round(1 - 28e-1 * (1 - i / 20e0) / (1 + 18e-1 * (1 - i / 20e0)), 9) AS t FROM nation, (SELECT unnest(range(21)) AS i)")
def mth01(t):
    return t("nation").select("n_nationkey", F.posexplode(N.schedule(20, 2.8)).alias("i", "t")).withColumn("t", F.round("t", 9))


@query("mth01_uniform", "SELECT event_id, i::int AS i, i / n AS t FROM (SELECT event_id, 4e0 + 4 * (event_id % 3) AS n FROM events), (SELECT unnest(range(13)) AS i) WHERE i <= n")
def mth01u(t):
    """Each event is a sample that takes 4, 8 or 12 steps, evenly spaced."""
    steps = [4, 8, 12]
    each = [F.when(F.col("event_id") % 3 == k, N.schedule(n)) for k, n in enumerate(steps)]
    return t("events").select("event_id", F.posexplode(F.coalesce(*each)).alias("i", "t"))


@query("mth02_logit_normal", "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1 - ln(28e-1)))), 9) AS t FROM events")
def mth02(t):
    return t("events").select("event_id", F.round(N.logit_normal(F.col("value") / 50 - 1, N.shift_mean(2.8)), 9).alias("t"))


@query("mth03_cosine_topk", "WITH q AS (SELECT vec_id AS qid, embedding::double[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id, round(list_cosine_similarity(q, embedding::double[]), 6) AS sim FROM q, embeddings WHERE vec_id <> qid) SELECT qid, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r <= 5")
def mth03(t):
    """Stated queries (ids divisible by 50) against all vectors, a block of queries at a time."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return nearest.top(e.where("vec_id % 50 = 0"), e, "vec_id", "v", 5)


@query("mth04_dispersive", "WITH x AS (SELECT vec_id // 200 AS batch, vec_id, embedding::double[] AS v FROM embeddings), p AS (SELECT a.batch, -greatest(2 - 2 * list_cosine_similarity(a.v, b.v), 0) / 5e-1 AS e FROM x a JOIN x b ON a.batch = b.batch AND a.vec_id <> b.vec_id) SELECT batch::bigint AS batch, round(ln(avg(exp(e))), 6) AS loss FROM p GROUP BY 1")
def mth04(t):
    """Every vector, in training batches of 200 ids: all pairs of a batch are the operator's definition."""
    x = t("embeddings").select(F.floor(F.col("vec_id") / 200).alias("batch"), "vec_id", "embedding")
    return gram.dispersive(x, "batch", "vec_id", "embedding", 0.5).select("batch", F.round("loss", 6).alias("loss"))


@query("mth05_mse", "WITH m AS (SELECT label, vec_id, embedding::double[] AS v FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(range(64), lambda i: pow(a.v[i + 1] - b.v[i + 1], 2))) / 64, 9) AS mse FROM m a JOIN m b ON b.vec_id = a.vec_id + 1")
def mth05(t):
    e = t("embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.mse(F.col("embedding"), F.col("b")), 9).alias("mse"))


@query("mth06_logp", "WITH m AS (SELECT vec_id, embedding::double[] AS v FROM embeddings) SELECT vec_id, round(-(list_sum(list_transform(v, lambda x: pow(x, 2))) / 64) / (2 * 25e-2) - ln(5e-1) - 5e-1 * ln(2 * pi()), 9) AS logp FROM m")
def mth06(t):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return t("embeddings").select("vec_id", F.round(N.gauss_logp(F.col("embedding"), zero, F.lit(0.5)), 9).alias("logp"))


@query("mth07_sde_step", "WITH s AS (SELECT event_id, value AS x, user_id / 1e1 AS v, (event_id % 10) / 1e1 AS t FROM events), g AS (SELECT *, 7e-1 * sqrt((1 - t) / CASE WHEN t > 0 THEN t ELSE 1e-1 END) AS sigma FROM s) SELECT event_id, round(x * (1 - sigma * sigma * 1e-1 / (2 * (1 - t))) + v * (1 + sigma * sigma * t / (2 * (1 - t))) * 1e-1, 8) AS m FROM g")
def mth07(t):
    s = t("events").select("event_id", F.col("value").alias("x"), (F.col("user_id") / 10).alias("v"), (F.col("event_id") % 10 / F.lit(10.0)).alias("t"))
    s = s.withColumn("sigma", N.sde_sigma(F.col("t"), F.lit(0.1), 0.7))
    return s.select("event_id", F.round(N.sde_mean(F.col("x"), F.col("v"), F.col("t"), F.lit(0.1), F.col("sigma")), 8).alias("m"))


@query("mth16_u8", "SELECT vec_id, list_transform(embedding::double[], lambda x: floor(x / greatest(list_max(embedding::double[]), 1e-9) * 255)::int) AS u FROM embeddings WHERE list_max(embedding) > 1e-3")
def mth16(t):
    return t("embeddings").where(F.array_max("embedding") > F.lit(0.001).cast("float")).select("vec_id", N.to_u8(F.col("embedding")).alias("u"))


@query("mth11_roundtrip", "SELECT vec_id, round(embedding[1]::double, 5) AS x FROM embeddings")
def mth11r(t):
    mean, std = F.transform("embedding", lambda x: F.lit(0.25)), F.transform("embedding", lambda x: F.lit(2.0))
    z = N.unwhiten(N.whiten(F.col("embedding"), mean, std), mean, std)
    return t("embeddings").select("vec_id", F.round(F.get(z, 0), 5).alias("x"))


@query("udf05_probe")
def udf05(t):
    """Held-out scores of a logistic probe: label 0 against the others, trained on even ids."""
    e = t("embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("double").alias("y"))
    model = probe.fit(e.where("vec_id % 2 = 0"), "embedding", "y")
    return model.score(e.where("vec_id % 2 = 1"), "embedding").select("vec_id", F.round("p", 6).alias("p"))
