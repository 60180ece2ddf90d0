"""Queries of scans, projections, filters and scalar functions (SRC, PRJ, FLT, STR, ARR, MAP, JSN)."""

from pyspark.sql import functions as F

from loomspan.functions import numeric as N
from loomspan.functions import text as S
from loomspan.operators import curate as C

from .registry import query, u01_sql, words_sql

DOUBLE_RATIO = "(l_quantity / (1 + l_partkey % 50)::double)"
#: Trimmed of all white space.
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def first_sentence_sql(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    cases = " ".join(f"WHEN instr({t}, {e}) > 1 AND instr({t}, {e}) < length({t}) THEN {trim(f'substr({t}, 1, instr({t}, {e}))')}" for e in ("'. '", "'! '", "'? '", "'.' || chr(10)"))
    return f"CASE {cases} ELSE {t} END"


def crop_sql(a: str, b: str) -> str:
    return f"(1 - least({a}, {b}) / greatest({a}, {b}))"


ASPECTS = {k: f"({w}::double / {h}::double)" for k, (w, h) in C.BUCKETS.items()}


def bucket_sql(aspect: str, key: str) -> str:
    """(bucket) of real images."""
    near = "list_min([" + ", ".join(f"{{'crop': {crop_sql(aspect, a)}, 'i': {i}, 'b': '{k}'}}" for i, (k, a) in enumerate(ASPECTS.items())) + "]).b"
    return f"CASE WHEN {aspect} < 5e-1 OR {aspect} > 2e0 THEN NULL WHEN {crop_sql(aspect, ASPECTS['1_1'])} <= 3e-1 AND {u01_sql(key)} < 5e-1 THEN '1_1' ELSE {near} END"


@query("src01_project", "SELECT o_orderkey, o_totalprice FROM orders")
def src01(t):
    return t("orders").select("o_orderkey", "o_totalprice")


@query("src12_rows_by_type", "SELECT event_type, count(*)::bigint AS n FROM events WHERE trim(props) <> '' GROUP BY 1")
def src12(t):
    return t("events").where(F.trim("props") != "").groupBy("event_type").agg(F.count("*").alias("n"))


@query("src18_prompt_lines", "SELECT item_id, line FROM (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) WHERE line <> ''")
def src18(t):
    return t("benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", F.trim("line").alias("line")).where("line <> ''")


@query("src21_score_book", "SELECT event_type AS grp, user_id::varchar AS file, 'k' AS metric, avg((props::json->>'k')::double)::double AS value FROM events GROUP BY ALL")
def src21(t):
    """Nested maps group -> file -> metric, exploded twice into a long table."""
    per = t("events").groupBy("event_type", "user_id").agg(F.avg(F.get_json_object("props", "$.k").cast("double")).alias("k"))
    book = per.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), F.create_map(F.lit("k"), "k")))).alias("files"))
    long = book.select(F.col("event_type").alias("grp"), F.explode("files").alias("file", "metrics"))
    return long.select("grp", "file", F.explode("metrics").alias("metric", "value"))


@query("prj01_row_assembly", f"""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS caps FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT d.doc_id::varchar AS id, d.text, c.caps FROM documents d LEFT JOIN c ON d.doc_id = c.conv_id),
s AS (SELECT id, list_filter(list_transform([text], lambda x: {trim('x')}), lambda x: x <> '') AS l,
  list_filter(list_transform(coalesce(caps, []), lambda x: {trim('x')}), lambda x: x <> '') AS s FROM r)
SELECT id, len(CASE WHEN len(l) > 0 THEN l ELSE s END)::bigint AS n_long, CASE WHEN len(s) > 0 THEN s[1] ELSE {first_sentence_sql('l[1]')} END AS first_short
FROM s WHERE len(l) > 0 OR len(s) > 0""")
def prj01(t):
    caps = C.grouped_captions(t("conversations").where("role = 'user'"), "conv_id", "turn", "text")
    d = t("documents").join(caps, F.col("doc_id") == F.col("conv_id"), "left")
    r = d.select(F.col("doc_id").cast("string").alias("id"), C.assemble(F.array("text"), F.col("captions")).alias("r")).where("r is not null")
    return r.select("id", F.size("r.long").cast("bigint").alias("n_long"), F.get("r.short", 0).alias("first_short"))


@query("prj02_nested", "SELECT event_id, (props::json->>'k')::bigint AS k, (props::json->>'none') AS missing FROM events")
def prj02(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("prj03_prefix", "SELECT event_id, event_type AS eval_event_type, value AS eval_value FROM events")
def prj03(t):
    return C.prefixed(t("events").select("event_id", "event_type", "value"), "eval_", ["event_id"])


@query("prj04_required", "SELECT doc_id, quality FROM labels")
def prj04(t):
    return C.required(t("labels"), ["doc_id", "quality"]).select("doc_id", "quality")


@query("prj05_crop", f"SELECT l_orderkey, round({crop_sql(DOUBLE_RATIO, ASPECTS['4_3'])}, 4) AS crop FROM lineitem")
def prj05(t):
    return t("lineitem").select("l_orderkey", F.round(C.crop_fraction(F.col("l_quantity") / (1 + F.col("l_partkey") % 50).cast("double"), "4_3"), 4).alias("crop"))


@query("prj06_bucket", f"SELECT l_orderkey, l_linenumber, {bucket_sql(DOUBLE_RATIO, chr(39) + 'real' + chr(39) + ' || l_orderkey || ' + chr(39) + '-' + chr(39) + ' || l_linenumber')} AS bucket FROM lineitem")
def prj06(t):
    key = F.concat(F.lit("real"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", C.bucket(F.col("l_quantity") / (1 + F.col("l_partkey") % 50).cast("double"), True, key)["bucket"].alias("bucket"))


@query("prj06_bucket_synthetic", f"""SELECT l_orderkey, l_linenumber, CASE WHEN {DOUBLE_RATIO} < 5e-1 OR {DOUBLE_RATIO} > 2e0 THEN NULL WHEN {u01_sql("l_orderkey || '-' || l_linenumber")} < 45e-2 THEN '1_1'
 ELSE ['4_3', '3_4', '3_2', '2_3'][1 + floor({u01_sql("l_orderkey || '-' || l_linenumber || '/b'")} * 4)::int] END AS bucket FROM lineitem""")
def prj06s(t):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", C.bucket(F.col("l_quantity") / (1 + F.col("l_partkey") % 50).cast("double"), False, key)["bucket"].alias("bucket"))


@query("prj07_routing", f"""WITH p AS (SELECT p_partkey, coalesce(nullif({trim("CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END")}, ''), nullif({trim('p_brand')}, '')) AS short, p_type AS detail, p_size FROM part)
SELECT p_partkey, short, CASE WHEN p_size / 1e2 > 2e-1 THEN short ELSE detail END AS long FROM p""")
def prj07(t):
    p = t("part")
    r = C.route_captions(F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_name")), F.col("p_brand"), F.col("p_type"), F.col("p_size") / F.lit(100.0))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.short", "r.long")


@query("prj08_clip", "SELECT doc_id, substr(text, 1, 200) AS head, substr(n_chars::varchar, 1, 200) AS chars FROM documents")
def prj08(t):
    return t("documents").select("doc_id", S.clipped(F.col("text")).alias("head"), S.clipped(F.col("n_chars")).alias("chars"))


@query("flt01_aspect", f"SELECT count(*)::bigint AS n FROM lineitem WHERE {DOUBLE_RATIO} BETWEEN 5e-1 AND 2e0")
def flt01(t):
    return t("lineitem").where(C.in_range(F.col("l_quantity") / (1 + F.col("l_partkey") % 50).cast("double"))).agg(F.count("*").alias("n"))


@query("flt02_scores", "SELECT p_partkey FROM part WHERE p_size >= 9 AND p_retailprice >= 950")
def flt02(t):
    """Null counts as 0, so plain comparisons do, and they reach the scan."""
    return t("part").where("p_size >= 9 and p_retailprice >= 950").select("p_partkey")


@query("flt03_marker", "SELECT page_id FROM pages WHERE contains(url, '/a')")
def flt03(t):
    return t("pages").where(F.col("url").contains("/a")).select("page_id")


@query("flt04_split", "SELECT quality = 0 AS val, count(*)::bigint AS n FROM labels GROUP BY 1")
def flt04(t):
    return t("labels").groupBy((F.col("quality") == 0).alias("val")).agg(F.count("*").alias("n"))


@query("flt05_kind", "SELECT event_id, json_exists(props::json, '$.k') AS has_k, json_exists(props::json, '$.fid') AS has_fid FROM events")
def flt05(t):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.map_contains_key(m, "k").alias("has_k"), F.map_contains_key(m, "fid").alias("has_fid"))


@query("flt06_words", f"SELECT doc_id FROM documents WHERE {words_sql('text')} BETWEEN 4 AND 30")
def flt06(t):
    return t("documents").where(S.word_count(F.col("text")).between(4, 30)).select("doc_id")


@query("flt07_band", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::bigint AS passes FROM events GROUP BY 1 HAVING passes BETWEEN 2 AND 40")
def flt07(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("passes")).where("passes between 2 and 40")


@query("flt08_default_keep", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1")
def flt08(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").where("coalesce(quality, 1) = 1").select("doc_id")


@query("flt09_numbers", "SELECT count(*)::bigint AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::double ELSE value END AS v FROM events) WHERE v IS NOT NULL AND NOT isnan(v)")
def flt09(t):
    from loomspan.operators.evaluate import numbers

    v = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return numbers(t("events").select(v.alias("v")), "v").agg(F.count("*").alias("n"))


@query("flt10_keys", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def flt10(t):
    keep = t("customer").where("c_mktsegment = 'BUILDING'")
    return t("orders").join(keep, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("flt12_held_out", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)")
def flt12(t):
    return t("documents").join(t("labels").where("doc_id % 2 = 0"), "doc_id", "left_anti").select("doc_id")


@query("flt13_group_size", "SELECT o_custkey, count(*)::bigint AS n FROM orders GROUP BY 1 HAVING count(*) >= 6 AND stddev_pop(o_totalprice) > 0")
def flt13(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.stddev_pop("o_totalprice").alias("sd")).where("n >= 6 and sd > 0").select("o_custkey", "n")


@query("flt14_veto", "SELECT event_id, (value < 2e-2 OR event_type = 'error') AS veto FROM events")
def flt14(t):
    return t("events").select("event_id", ((F.col("value") < 0.02) | (F.col("event_type") == "error")).alias("veto"))


@query("str01_first_sentence", f"SELECT doc_id, {first_sentence_sql('text')} AS s FROM documents")
def str01(t):
    return t("documents").select("doc_id", S.first_sentence(F.col("text")).alias("s"))


@query("str02_strip", f"SELECT doc_id, length({trim('text')})::bigint AS n FROM documents")
def str02(t):
    return t("documents").select("doc_id", F.length(S.strip(F.col("text"))).cast("bigint").alias("n"))


@query("str03_url_id", "SELECT page_id, try_cast(split_part(string_split(url, '/')[-1], '.', 1) AS bigint) AS id FROM pages")
def str03(t):
    return t("pages").select("page_id", S.url_id(F.col("url")).alias("id"))


@query("str04_url_query", "SELECT page_id, string_split(url, '?')[1] || '?auto=compress' AS url FROM pages")
def str04(t):
    return t("pages").select("page_id", S.url_with(F.col("url"), "auto=compress").alias("url"))


@query("str05_names", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS ext FROM pages")
def str05(t):
    return t("pages").select("page_id", S.basename(F.col("url")).alias("base"), S.extension(F.col("url")).alias("ext"))


@query("str06_words", f"SELECT doc_id, {words_sql('text')}::bigint AS n, {words_sql('text')} > 30 AS is_long FROM documents")
def str06(t):
    n = S.word_count(F.col("text"))
    return t("documents").select("doc_id", n.cast("bigint").alias("n"), (n > 30).alias("is_long"))


@query("str07_tokens", f"SELECT doc_id, round({words_sql('text')} * 135e-2, 4) AS tokens, {words_sql('text')} * 135e-2 > 64 AS over FROM documents")
def str07(t):
    return t("documents").select("doc_id", F.round(S.token_estimate(F.col("text")), 4).alias("tokens"), S.over_limit(F.col("text")).alias("over"))


def flagged_sql(x: str) -> str:
    t = f"lower({trim(f'coalesce({x}, chr(32))')})"
    h = f"substr({t}, 1, {S.HEAD})"
    return f"NOT ({t} = '' OR starts_with({t}, 'none') OR (regexp_matches({h}, '{S.DENIES}') AND NOT regexp_matches({h}, '{S.LISTS}')))"


@query("str08_flagged", f"SELECT conv_id, turn, {flagged_sql('text')} AS flagged FROM conversations")
def str08(t):
    return t("conversations").select("conv_id", "turn", S.flagged(F.col("text")).alias("flagged"))


@query("str09_json_number", "SELECT event_id, try_cast(regexp_extract('score ' || props || ' end', '(\\{[^}]*\\})', 1)::json->>'k' AS double) AS k FROM events")
def str09(t):
    return t("events").select("event_id", S.json_number(F.concat(F.lit("score "), F.col("props"), F.lit(" end")), "k").alias("k"))


@query("str10_template", "SELECT n_nationkey, 'a photo of a ' || n_name AS prompt FROM nation")
def str10(t):
    return t("nation").select("n_nationkey", S.template("a photo of a %s", F.col("n_name")).alias("prompt"))


@query("str11_article", "SELECT n_nationkey, CASE WHEN substr(lower(n_name), 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || lower(n_name) AS s FROM nation")
def str11(t):
    return t("nation").select("n_nationkey", S.with_article(F.lower("n_name")).alias("s"))


@query("str12_dots", f"SELECT doc_id, regexp_replace({trim('text')}, '\\.+$', '') AS s FROM documents")
def str12(t):
    return t("documents").select("doc_id", S.drop_trailing_dots(S.strip(F.col("text"))).alias("s"))


@query("str13_join_first", "SELECT conv_id, array_to_string(list(text ORDER BY turn)[1:5], ' | ') AS s FROM conversations GROUP BY 1")
def str13(t):
    return C.grouped_captions(t("conversations"), "conv_id", "turn", "text").select("conv_id", S.join_first(F.col("captions")).alias("s"))


@query("str14_data_url", "SELECT n_nationkey, 'data:text/plain;base64,' || base64(encode(n_name)) AS u FROM nation")
def str14(t):
    return t("nation").select("n_nationkey", S.data_url(F.col("n_name").cast("binary"), "text/plain").alias("u"))


@query("str14_long_data_url", "SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(coalesce(text, '')))) AS h FROM documents")
def str14l(t):
    """Texts of any length stay on one line."""
    url = S.data_url(F.coalesce(F.col("text"), F.lit("")).cast("binary"), "text/plain")
    return t("documents").select("doc_id", F.md5(url).alias("h"))


@query("str15_md5", "SELECT doc_id, md5(doc_id::varchar) AS h FROM documents")
def str15(t):
    return t("documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))


@query("str16_dash", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN '—' ELSE l.quality || '.00' END AS s FROM documents d LEFT JOIN labels l USING (doc_id)")
def str16(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", S.number_or_dash(F.col("quality").cast("double")).alias("s"))


@query("str17_script_safe", "SELECT page_id, replace(html, '</', '<\\/') AS h FROM pages")
def str17(t):
    return t("pages").select("page_id", S.script_safe(F.col("html")).alias("h"))


@query("str18_affixes", "SELECT page_id, starts_with(url, 'https') AS https, ends_with(url, '0') AS zero FROM pages")
def str18(t):
    return t("pages").select("page_id", F.col("url").startswith("https").alias("https"), F.col("url").endswith("0").alias("zero"))


@query("arr01_slice", "SELECT conv_id, list_filter(list(text ORDER BY turn)[1:3], lambda x: x <> '') AS s FROM conversations GROUP BY 1")
def arr01(t):
    return C.grouped_captions(t("conversations"), "conv_id", "turn", "text").select("conv_id", F.filter(F.slice("captions", 1, 3), lambda x: x != "").alias("s"))


@query("arr02_pick", f"SELECT conv_id, list(text ORDER BY turn)[1 + floor({u01_sql('conv_id::varchar')} * count(*))::int] AS s FROM conversations GROUP BY 1")
def arr02(t):
    from loomspan.functions.hashing import u01

    return C.grouped_captions(t("conversations"), "conv_id", "turn", "text").select("conv_id", N.pick(F.col("captions"), u01(F.col("conv_id").cast("string"))).alias("s"))


@query("arr04_pad", "SELECT vec_id, list_concat(embedding::double[], [0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0]) AS v, len(embedding)::bigint AS n FROM embeddings")
def arr04(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", N.pad(v, 72, F.lit(0.0)).alias("v"), F.size(v).cast("bigint").alias("n"))


@query("map01_default", "SELECT event_id, coalesce(json_extract_string(props::json, '$.k'), 'x') AS k, coalesce(json_extract_string(props::json, '$.z'), 'x') AS z FROM events")
def map01(t):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", N.get_or(m, "k", F.lit("x")).alias("k"), N.get_or(m, "z", F.lit("x")).alias("z"))


@query("jsn01_parse_or_skip", "SELECT event_id FROM events WHERE json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END)")
def jsn01(t):
    cut = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 1000)).otherwise(F.col("props"))
    return t("events").where(F.from_json(cut, "map<string,string>").isNotNull()).select("event_id")


@query("arr03_unique_repeat", "SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, list_sort(list(role)) AS every FROM conversations GROUP BY 1")
def arr03(t):
    return t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_list("role")).alias("every"))


@query("src02_row_groups", "SELECT count(*)::bigint AS n, sum(l_quantity)::double AS q FROM lineitem")
def src02(t):
    """Splits bound a task's memory; only one column is read."""
    return t("lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
