"""Text functions (STR): column builders, all inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends in order of priority.
SENTENCE_ENDS = (". ", "! ", "? ", ".\n")
# Patterns that decide whether a description names an error.
HEAD = 220
DENIES = r"\b(no|without any|free of|does not (contain|have|show))\b[^.]{0,60}\b(errors?|artifacts?|issues?|problems?)"
LISTS = (
    r"here are (the |some |a few )?(potential |possible |notable |several )?(visual )?(errors|artifacts|issues)|"
    r"(contains|has|shows|exhibits) (the following|several|some|a few|multiple|notable) (visual )?(errors|artifacts|issues)|"
    r"the following (visual )?(errors|artifacts|issues)"
)
# Tokens a word, token limit.
TOKENS_PER_WORD, TOKEN_LIMIT = 1.35, 64


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a plain column would be repeated wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """STR-02: white space of any kind off both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def word_count(c: Column) -> Column:
    """STR-06: words between white space; null counts as 0."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def first_sentence(c: Column) -> Column:
    """STR-01: up to the first sentence end of the first kind that splits the text; kinds go by priority, not by place."""

    def split(t: Column) -> Column:
        out = t
        for end in reversed(SENTENCE_ENDS):
            at = F.instr(t, end)
            out = F.when((at > 1) & (at < F.length(t)), strip(F.substring(t, F.lit(1), at))).otherwise(out)
        return out

    return let(strip(F.coalesce(c, F.lit(""))), split)


def url_id(c: Column) -> Column:
    """STR-03: number at the end of a URL's path, null where there is none."""
    return F.split_part(F.element_at(F.split(c, "/"), -1), F.lit("."), F.lit(1)).try_cast("bigint")


def url_with(c: Column, query: str) -> Column:
    """STR-04: the URL with another query string."""
    return F.concat(F.substring_index(c, "?", 1), F.lit("?" + query))


def basename(c: Column) -> Column:
    """STR-05."""
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """STR-05: lower-case extension of the last path part, empty where there is none."""
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]*)$", 1))


def token_estimate(c: Column) -> Column:
    """STR-07."""
    return word_count(c) * F.lit(TOKENS_PER_WORD)


def over_limit(c: Column) -> Column:
    """STR-07."""
    return token_estimate(c) > F.lit(TOKEN_LIMIT)


def flagged(c: Column) -> Column:
    """STR-08: does a free description name an error?"""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    head = F.substring(t, 1, HEAD)
    return ~((t == "") | t.startswith("none") | (head.rlike(DENIES) & ~head.rlike(LISTS)))


def flagged_simple(c: Column) -> Column:
    """STR-08, the short variant."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return ~(strip(t).startswith("none") | F.substring(t, 1, 120).contains(" no "))


def json_number(c: Column, field: str) -> Column:
    """STR-09, JSN-01: a numeric field of the first {...} in free text, else null."""
    value = F.get_json_object(F.regexp_extract(c, r"(\{[^}]*\})", 1), f"$.{field}")
    return F.when(value.rlike(r"^[0-9]*\.?[0-9]*$") & value.rlike("[0-9]"), value.try_cast("double"))


def template(form: str, *columns: Column) -> Column:
    """STR-10: printf-style prompt."""
    return F.format_string(form, *columns)


def with_article(c: Column) -> Column:
    """STR-11: only lower-case vowels take 'an'."""
    return F.concat(F.when(F.substring(c, 1, 1).isin(*"aeiou"), F.lit("an ")).otherwise(F.lit("a ")), c)


def drop_trailing_dots(c: Column) -> Column:
    """STR-12."""
    return F.regexp_replace(c, r"\.+$", "")


def join_first(c: Column, n: int = 5, sep: str = " | ") -> Column:
    """STR-13."""
    return F.array_join(F.slice(c, 1, n), sep)


def data_url(c: Column, kind: str) -> Column:
    """STR-14: one line, whatever its length (Spark may break base64 into lines of 76)."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(c), "\r\n", ""))


def number_or_dash(c: Column, places: int = 2) -> Column:
    """STR-16: null and NaN as a dash."""
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(F.format_number(c, places))


def script_safe(c: Column) -> Column:
    """STR-17."""
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def clipped(c: Column, n: int = 200) -> Column:
    """PRJ-08: any scalar as text of at most n characters."""
    return F.substring(c.cast("string"), 1, n)
