"""Evaluation: AUROC, signal-to-noise, rank correlation, pass@k, bootstrap, Fréchet distance, advantages."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Metrics where low is good.
LOW_IS_GOOD = ("artifact", "aislop")


def numbers(df: DataFrame, column: str) -> DataFrame:
    """FLT-09: without null and NaN."""
    return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))


def average_rank(partition: list[str], value: str) -> Column:
    """Rank with ties at their mean."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    return F.rank().over(ordered) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


#: Value ranges that a group's scores are dealt to, so that a large group is not one task.
RANGES = 1024


def auroc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """AGG-11: P(pos > neg) + P(equal) / 2 per group; null where a side is empty. All contrasts in one pass (AGG-16).

    Equal scores are counted before the shuffle. Each group's values are dealt to ranges in order; the negatives below a
    value are those of the ranges below, from one row a range, and those below it in its own range.
    """
    d = numbers(df, score).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(F.col(positive).cast("double")).alias("_p"), F.count("*").alias("_n"))
    d = d.withColumn("_q", F.col("_n") - F.col("_p"))
    finite = F.when(F.abs("_s") < float("inf"), F.col("_s"))
    ends = d.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    at = F.floor((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES)
    d = d.join(ends, by).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), at))).otherwise(F.signum(F.col("_s") - F.col("_lo"))).cast("int")).drop("_lo", "_hi")
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*by, "_b").agg(F.sum("_q").alias("_t")).withColumn("_under", F.coalesce(F.sum("_t").over(below), F.lit(0.0))).drop("_t")
    inside = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(ranges, [*by, "_b"]).withColumn("_less", F.col("_under") + F.coalesce(F.sum("_q").over(inside), F.lit(0.0)))
    g = d.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum(F.col("_p") * (F.col("_less") + F.col("_q") / 2)).alias("_u"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return g.select(*by, F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"), area.alias("auroc"))


def detection(metric: Column, area: Column) -> Column:
    """AGG-12: AUROC of detecting the bad class, whatever the metric's direction."""
    return F.when(metric.isin(*LOW_IS_GOOD), area).otherwise(F.lit(1.0) - area)


def win_rate(own: Column, other: Column) -> Column:
    """AGG-13: 1 for a win, a half for a tie, averaged."""
    return F.avg(F.when(own > other, 1.0).when(own == other, 0.5).otherwise(0.0))


def group_snr(df: DataFrame, by: list[str], group: str, score: str, noisy: str, least: int = 4, floor: float = 1e-9) -> DataFrame:
    """AGG-09, AGG-10, FLT-13: mean population deviation inside groups over mean change by noise."""
    per = df.groupBy(*by, group).agg(F.stddev_pop(score).alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    spread = per.groupBy(*by).agg(F.avg("sd").alias("group_std"))
    noise = df.groupBy(*by).agg(F.avg(F.abs(F.col(score) - F.col(noisy))).alias("noise"))
    return spread.join(noise, by).select(*by, "group_std", "noise", (F.col("group_std") / F.greatest("noise", F.lit(floor))).alias("snr"))


def rank_agreement(df: DataFrame, scorer: str, group: str, item: str, score: str, least: int = 6) -> DataFrame:
    """AGG-14, JOI-11: mean Spearman correlation inside groups for each unordered pair of scorers."""
    d = numbers(df, score).select(F.col(scorer).alias("s"), F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("x"))
    pairs = d.alias("a").join(d.alias("b"), ["g", "i"]).where("a.s < b.s").select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), "g", F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    by = ["a", "b", "g"]
    ranked = pairs.withColumn("rx", average_rank(by, "x")).withColumn("ry", average_rank(by, "y"))
    per = ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    kept = per.where((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0))
    return kept.where(~F.isnan("rho")).groupBy("a", "b").agg(F.avg("rho").alias("agreement"), F.count("*").alias("n_groups"))


def pass_at(c: Column, n: Column, k: int) -> Column:
    """AGG-19: 1 - C(n - c, k) / C(n, k) as a product, so that nothing overflows."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i).cast("double") / (n - i).cast("double"))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def soft_best(scores: DataFrame, prompt: str, score: str, n: int, k: int) -> DataFrame:
    """AGG-20, WIN-13: expected best of k out of n scores. Weights are exact integers of the driver, one row a rank."""
    weights = scores.sparkSession.createDataFrame([(i + 1, comb(i, k - 1) / comb(n, k)) for i in range(n)], "_r int, _w double")
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy(prompt).orderBy(score)))
    return ranked.join(F.broadcast(weights), "_r").groupBy(prompt).agg(F.sum(F.col(score) * F.col("_w")).alias("soft_best"))


def resampled(n_rows: int, n_draws: Column, seed: Column) -> Column:
    """AGG-23: row index of a bootstrap draw, by hash."""
    from loomspan.functions.hashing import u01

    return F.floor(u01(F.concat_ws("/", seed, n_draws)) * F.lit(n_rows)).cast("int")


def frechet(a: tuple, b: tuple) -> float:
    """AGG-18: distance of two groups from their (means, covariances); d x d work on the driver."""
    import numpy as np

    (ma, sa), (mb, sb) = a, b
    values = np.linalg.eigvals(sa @ sb)
    if not np.isfinite(values).all():
        values = np.linalg.eigvals((sa + 1e-6 * np.eye(len(ma))) @ (sb + 1e-6 * np.eye(len(ma))))
    return float(((ma - mb) ** 2).sum() + np.trace(sa) + np.trace(sb) - 2 * np.sqrt(np.maximum(values.real, 0)).sum())


def group_advantage(df: DataFrame, reward: str, group: str, eps: float = 1e-4) -> DataFrame:
    """WIN-02: df with `advantage`: centred in the group, over the sample deviation of all, which is one aggregated row."""
    spread = df.agg(F.stddev_samp(reward).alias("_sd"))
    centred = F.col(reward) - F.avg(reward).over(Window.partitionBy(group))
    return df.crossJoin(F.broadcast(spread)).withColumn("advantage", centred / (F.col("_sd") + F.lit(eps))).drop("_sd")


def combined_advantage(df: DataFrame, group: str, weights: dict[str, float], veto: str, centred: tuple[str, ...] = ("style",), eps: float = 1e-4) -> DataFrame:
    """WIN-03, WIN-04: weighted terms, centred in the group and (but for `centred`) over the population deviation of all.

    Vetoed rows get the least of -2 and the group's minimum, vetoed rows' own values included. The deviations come from one
    aggregated row, so the samples are not gathered in one window.
    """
    spread = df.agg(*[F.stddev_pop(k).alias(f"_sd_{k}") for k in weights])
    g = Window.partitionBy(group)
    out = df.crossJoin(F.broadcast(spread))
    total = F.lit(0.0)
    for k, w in weights.items():
        a = F.col(k) - F.avg(k).over(g)
        out = out.withColumn(f"a_{k}", a if k in centred else a / (F.col(f"_sd_{k}") + F.lit(eps)))
        total = total + F.lit(w) * F.col(f"a_{k}")
    out = out.withColumn("_adv", total)
    low = F.least(F.min("_adv").over(g), F.lit(-2.0))
    return out.withColumn("advantage", F.when(F.col(veto) > 0, low).otherwise(F.col("_adv"))).drop("_adv", *[f"_sd_{k}" for k in weights])


def style_penalty(stats: dict[str, tuple[float, float, float]]) -> Column:
    """WIN-14: name -> (p5, p95, std): distance outside the range in deviations, summed and negated."""
    out = F.lit(0.0)
    for name, (p5, p95, sd) in stats.items():
        x = F.col(name)
        out = out + F.greatest((x - p95) / sd, F.lit(0.0)) + F.greatest((F.lit(p5) - x) / sd, F.lit(0.0))
    return -out


def preference_gate(df: DataFrame, group: str, beta: float, size: int) -> DataFrame:
    """MTH-08: margin and gate of each group from per-sample advantage `adv`, loss `dsm` and reference loss `ref_dsm`."""
    margin = F.sum(F.col("adv") * F.lit(beta) * (F.col("dsm") - F.col("ref_dsm"))) / F.lit(float(size))
    return df.groupBy(group).agg(margin.alias("margin")).withColumn("gate", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))))
