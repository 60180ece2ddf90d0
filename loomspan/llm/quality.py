"""Quality rules: base statistics and a learned decision list, in DataFrame functions only.

Statistics are per row; nothing is shuffled but the labelled rows. The list is learned by sequential
covering: threshold conjunctions grow by FOIL gain on two thirds of the labelled rows, are pruned on the
other third, and are emitted as one ordered `when` expression. With no usable labels the list is empty and
only the base rule rejects.

Null and empty texts have zero words and fail the base rule. Repeated rows are judged alike, each by its own
text. Labels: null ids and documents with contradicting labels are left out; a label that repeats counts once.
Very long texts (over 2^21 words) take the slower exact path of `repeated_words`. Extra columns of the
documents are carried through, but those named like a column made here are replaced; helper columns start with an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MADE = [*BASE, "n_upper", "n_bangs", "n_digits", "base_failed", "rule", "kept"]
#: Labelled documents that the list is fitted on at most, taken by hash of their id.
LABELLED_ROWS = 8192
#: Candidate thresholds a feature.
CUTS = 24
MAX_RULES, MAX_CONDITIONS = 12, 3
#: A rule must reach this precision on the pruning third, over so many rejected rows at least.
PRECISION, SUPPORT = 0.97, 4
INDEX_BITS = 21


def _packed(h: Column, n: Column) -> Column:
    """Sorted longs of 43 hash bits and the window's place: a primitive sort."""
    return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, INDEX_BITS).bitwiseOR(i.cast("long"))))


def with_stats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the base statistics and a few more for the learned rules."""
    mask, zero = (1 << INDEX_BITS) - 1, F.array().cast("array<long>")
    key = lambda v: F.shiftright(v, INDEX_BITS)
    d = docs.drop(*MADE).withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(common.WORD), F.lit(0)))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(common.WORD)))
    d = d.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("[!?]")).cast("long").alias("n_bangs"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"),
    ).drop("_lines", "_w", "_t")
    d = d.withColumn("_h", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_wh", i), F.get("_wh", i + 1), F.get("_wh", i + 2)))).otherwise(zero)).drop("_wh")
    d = d.withColumn("_again", F.size("_h") > F.size(F.array_distinct("_h")))
    d = d.withColumn("_s", F.when(F.col("_again") & (F.col("n_words") < (1 << INDEX_BITS)), _packed(F.col("_h"), F.col("n_words"))).otherwise(zero))
    # Neighbours with equal hash bits are repeats; where the left-out bits differ, the row takes the exact path.
    same = lambda a, b: F.coalesce(key(a) == key(b), F.lit(False))
    d = d.withColumn("_p", F.transform(F.filter("_s", lambda v, k: same(v, F.get("_s", k - 1)) | same(v, F.get("_s", k + 1))), lambda v: v.bitwiseAND(F.lit(mask).cast("long")).cast("int")))
    d = d.withColumn("_odd", F.exists(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda k: F.coalesce(F.get("_h", F.get("_p", k)) != F.get("_h", F.get("_p", k - 1)), F.lit(False)) & same(F.shiftleft(F.get("_h", F.get("_p", k)), INDEX_BITS), F.shiftleft(F.get("_h", F.get("_p", k - 1)), INDEX_BITS))))
    exact = F.when(F.col("_again") & (F.col("_odd") | (F.col("n_words") >= (1 << INDEX_BITS))), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    d = d.withColumn("_e", exact)
    hit = lambda v, o: F.coalesce(v["x"] == o["x"], F.lit(False))
    places = F.when(F.size("_e") > 0, F.transform(F.filter("_e", lambda v, k: hit(v, F.get("_e", k - 1)) | hit(v, F.get("_e", k + 1))), lambda v: v["i"])).otherwise(F.col("_p"))
    d = d.withColumn("_q", F.sort_array(places))
    covered = F.aggregate(F.transform("_q", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_q", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", covered).drop("_h", "_again", "_s", "_p", "_odd", "_e", "_q")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "bangs_per_word": F.col("n_bangs") / words,
        "digit_share": F.col("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def learn(rows: list[tuple[tuple[float, ...], bool, int]], names: list[str]) -> list[Rule]:
    """Ordered rejection rules from (feature values, is bad, fold 0..2) rows; fold 0 prunes, the others grow.

    Bounded driver work: sets of labelled rows are bit sets.
    """
    import math

    bad = sum(1 << i for i, r in enumerate(rows) if r[1])
    prune = sum(1 << i for i, r in enumerate(rows) if r[2] == 0)
    every = (1 << len(rows)) - 1
    conditions: list[tuple[Condition, int]] = []
    for f, name in enumerate(names):
        values = sorted({r[0][f] for r in rows})
        places = sorted({round(k * (len(values) - 2) / (CUTS - 1)) for k in range(CUTS)}) if len(values) > 1 else []
        for cut in [(values[i] + values[i + 1]) / 2 for i in places]:
            above = sum(1 << i for i, r in enumerate(rows) if r[0][f] > cut)
            conditions += [(Condition(name, True, cut), above), (Condition(name, False, cut), every & ~above)]
    conditions.sort(key=lambda c: (c[0].feature, c[0].above, c[0].cut))
    left, rules = every, []
    while len(rules) < MAX_RULES:
        chosen, covers = [], left & ~prune
        while len(chosen) < MAX_CONDITIONS:
            p0, n0 = (covers & bad).bit_count(), (covers & ~bad).bit_count()
            if not p0 or not n0:
                break
            best, ties = 1e-9, []
            for c, rowset in conditions:
                p = (covers & rowset & bad).bit_count()
                if p:
                    n = (covers & rowset & ~bad).bit_count()
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > best + 1e-9:
                        best, ties = gain, [(c, rowset)]
                    elif ties and gain > best - 1e-9 and (c.feature, c.above) == (ties[0][0].feature, ties[0][0].above):
                        ties.append((c, rowset))
            if not ties:
                break
            chosen.append(ties[len(ties) // 2])  # cuts that do as well: the middle one
            covers &= chosen[-1][1]
        worth = []
        for k in range(1, len(chosen) + 1):  # prune: the prefix that is worth most on the pruning rows
            s = left
            for _, rowset in chosen[:k]:
                s &= rowset
            p, n = (s & prune & bad).bit_count(), (s & prune & ~bad).bit_count()
            grown_p, grown_n = (s & ~prune & bad).bit_count(), (s & ~prune & ~bad).bit_count()
            ok = p + grown_p >= SUPPORT and grown_p >= PRECISION * (grown_p + grown_n) and p >= PRECISION * (p + n)
            worth.append((ok, p - n, -k, s))
        if not worth or not max(worth)[0]:
            break
        _, _, k, s = max(worth)
        rules.append(tuple(c for c, _ in chosen[:-k]))
        left &= ~s
    return rules


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> list[Rule]:
    """Decision list from `labels` (doc_id, quality) over at most `bound` labelled documents, one row each: an id has one vote."""
    sample = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi").select(F.col("doc_id").alias("_id"), (F.col("lo") == 0).alias("_bad"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound)
    )
    # At most `bound` rows of 9 bytes: a broadcast of proven size.
    labelled = common.one_each(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")), "_id", "_bad")
    named = features()
    # A filter on the statistics would be pushed below them and repeat their expressions, so it waits for the driver.
    got = with_stats(labelled).select("_id", "_bad", F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(3)).alias("_fold"), base_failed().alias("_failed"), *[c.alias(n) for n, c in named.items()]).collect()
    return learn([(tuple(r[4:]), r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], *r[4:])) if not r[3]], list(named))


def where(df: DataFrame, keep: Column) -> DataFrame:
    """df.where(keep) that Catalyst doesn't push below the statistics, whose expressions it would repeat for each element.

    A row number is not deterministic to Catalyst, so a filter stays above the projection that makes one.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where(keep & (F.col("_row") >= 0)).drop("_row")


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 where none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        hold = F.lit(True)
        for c in rules[k - 1]:
            hold &= c.column()
        out = F.when(hold, F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics, base_failed, rule and kept."""
    d = with_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, fit(docs, common.table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "kept", "rule")
