"""Queries of joins, set operations and generators (JOI, SET)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import text as S
from loomspan.operators import curate as C
from loomspan.operators import sampling as P

from .registry import query, words_sql


@query("joi01_grouped_left", "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT doc_id, len(l)::bigint AS n, l[1] AS first FROM documents LEFT JOIN c ON doc_id = conv_id")
def joi01(t):
    c = C.grouped_captions(t("conversations"), "conv_id", "turn", "text")
    d = t("documents").select("doc_id").join(c, F.col("doc_id") == F.col("conv_id"), "left")
    return d.select("doc_id", F.when(F.col("captions").isNotNull(), F.size("captions")).cast("bigint").alias("n"), F.get("captions", 0).alias("first"))


@query("joi02_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)")
def joi02(t):
    return t("documents").join(t("conversations"), F.col("doc_id") == F.col("conv_id"), "left_semi").select("doc_id")


@query("joi03_last_wins", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1")
def joi03(t):
    ids = t("documents").where("lang = 'en'")
    c = t("conversations").join(ids.select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi")
    return C.last_wins(c, ["conv_id"], F.col("turn")).select("conv_id", "text")


@query("joi04_default_empty", "WITH c AS (SELECT conv_id, count(*)::bigint AS n FROM conversations GROUP BY 1) SELECT doc_id, coalesce(n, 0)::bigint AS n FROM documents LEFT JOIN c ON doc_id = conv_id")
def joi04(t):
    c = C.grouped_captions(t("conversations"), "conv_id", "turn", "text")
    d = t("documents").join(c, F.col("doc_id") == F.col("conv_id"), "left")
    return d.select("doc_id", F.size(F.coalesce("captions", F.array().cast("array<string>"))).cast("bigint").alias("n"))


@query("joi05_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def joi05(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("joi06_inner_misses", "SELECT count(l.doc_id)::bigint AS hits, (count(*) - count(l.doc_id))::bigint AS misses FROM documents d LEFT JOIN labels l USING (doc_id)")
def joi06(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.agg(F.count("quality").alias("hits"), F.count_if(F.col("quality").isNull()).alias("misses"))


@query("joi07_overwrite", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN NULL ELSE 'labelled' END ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def joi07(t):
    side = t("labels").select("doc_id", F.when(F.col("toxic") != 1, "labelled").alias("lang"))
    return C.overwritten(t("documents").select("doc_id", "lang"), side, "doc_id", ["lang"])


@query("joi08_judged", "WITH j AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey, round(v, 6) AS j_value FROM customer LEFT JOIN j ON c_custkey = user_id")
def joi08(t):
    j = t("events").where("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg("value").alias("value"))
    return t("customer").select("c_custkey").join(C.prefixed(j, "j_", ["c_custkey"]), "c_custkey", "left").select("c_custkey", F.round("j_value", 6).alias("j_value"))


@query("joi09_work_list", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def joi09(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("joi10_labelled", "SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
def joi10(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "quality", "n_chars")


@query("joi11_pairs", "SELECT a.event_type AS a, b.event_type AS b, count(*)::bigint AS n FROM (SELECT DISTINCT event_type, user_id FROM events) a JOIN (SELECT DISTINCT event_type, user_id FROM events) b USING (user_id) WHERE a.event_type < b.event_type GROUP BY ALL")
def joi11(t):
    e = t("events").select("event_type", "user_id").distinct()
    return e.alias("a").join(e.alias("b"), "user_id").where("a.event_type < b.event_type").groupBy(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b")).agg(F.count("*").alias("n"))


@query("joi12_hard_negatives", "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT doc_id, i::int AS pos, l[i + 1] AS neg FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM documents JOIN c ON doc_id = conv_id)")
def joi12(t):
    c = C.grouped_captions(t("conversations"), "conv_id", "turn", "text")
    return t("documents").join(c, F.col("doc_id") == F.col("conv_id")).select("doc_id", F.posexplode("captions").alias("pos", "neg"))


@query("joi14_weights", "SELECT r_regionkey, count(*)::bigint AS n, sum(c_acctbal >= 0)::bigint AS positive FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def joi14(t):
    """Fixed dimension tables: broadcast."""
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("positive"))


def _half(t, odd: int):
    e = t("events").where(F.col("event_id") % 2 == odd)
    return e.groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("c"))


@query("joi15_baseline", "WITH h AS (SELECT user_id, event_id % 2 AS o, count(*) FILTER (WHERE value > 50)::bigint AS c FROM events GROUP BY ALL) SELECT b.user_id, (a.c - b.c)::bigint AS gain FROM h b JOIN h a USING (user_id) WHERE a.o = 1 AND b.o = 0")
def joi15(t):
    return _half(t, 0).withColumnRenamed("c", "b").join(_half(t, 1), "user_id").select("user_id", (F.col("c") - F.col("b")).alias("gain"))


@query("joi16_ordinal", "WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) AS r FROM benchmark) SELECT doc_id, item_id FROM a JOIN b USING (lang, r)")
def joi16(t):
    a = P.ordinals(t("documents").select("doc_id", "lang"), ["lang"], [], "doc_id", "r")
    b = t("benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    return a.join(P.ordinals(b, ["lang"], [], "item_id", "r"), ["lang", "r"]).select("doc_id", "item_id")


@query("joi17_by_bucket", "SELECT lang, count(*)::bigint AS n, min(doc_id)::bigint AS first FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def joi17(t):
    return t("documents").join(t("labels"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("set01_union", "SELECT src, count(*)::bigint AS n FROM (SELECT 'a' AS src FROM labels UNION ALL SELECT 'b' FROM benchmark) GROUP BY 1")
def set01(t):
    return C.merged([t("labels").select(F.lit("a").alias("src")), t("benchmark").select(F.lit("b").alias("src"))]).groupBy("src").agg(F.count("*").alias("n"))


@query("set03_diff", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set03(t):
    return t("orders").select("o_custkey").subtract(t("customer").where("c_acctbal < 0").select("c_custkey"))


@query("set04_intersection", "SELECT count(*)::bigint AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set04(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id")).agg(F.count("*").alias("n"))


@query("set05_distinct", f"SELECT DISTINCT regexp_replace(trim(text), '\\.+$', '') AS caption FROM documents WHERE {words_sql('text')} BETWEEN 4 AND 30")
def set05(t):
    d = t("documents").where(S.word_count(F.col("text")).between(4, 30))
    return d.select(S.drop_trailing_dots(F.trim("text")).alias("caption")).distinct()


@query("set06_chain", "SELECT 'first' AS run, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'second', event_id, value FROM events WHERE event_id % 2 = 1")
def set06(t):
    e = t("events").select("event_id", "value")
    return C.merged([e.where("event_id % 2 = 0").withColumn("run", F.lit("first")), e.where("event_id % 2 = 1").withColumn("run", F.lit("second"))])


@query("set07_cross", "SELECT r_name || ' ' || n_name AS prompt FROM region, nation")
def set07(t):
    """Two fixed lists."""
    return t("region").crossJoin(F.broadcast(t("nation"))).select(F.concat_ws(" ", "r_name", "n_name").alias("prompt"))


@query("set08_distinct_tuples", "SELECT r_name || '/' || a.n_name || '/' || b.n_name AS prompt FROM region, nation a, nation b ORDER BY md5('11' || r_name || '/' || a.n_name || '/' || b.n_name) LIMIT 800")
def set08(t):
    from loomspan.operators.sampling import shuffled_take

    a, b = t("nation").select(F.col("n_name").alias("a")), t("nation").select(F.col("n_name").alias("b"))
    every = t("region").crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).select(F.concat_ws("/", "r_name", "a", "b").alias("prompt"))
    return shuffled_take(every, "11", "prompt", 800)


@query("set09_exclude", "SELECT source, count(*)::bigint AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1")
def set09(t):
    return t("documents").where(~F.col("source").isin("src1", "src2")).groupBy("source").agg(F.count("*").alias("n"))


@query("set10_disjoint", "SELECT count(*)::bigint AS n FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def set10(t):
    return t("benchmark").join(t("documents").select("text"), "text", "left_anti").agg(F.count("*").alias("n"))
