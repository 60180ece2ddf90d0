"""Segmented scans against plain windows over whole runs."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import ledger, sampling, scan

SCHEMA = "run string, at double, id long, value double, n long"


def rows(r, n):
    runs = ["a"] * 6 + ["b", None, "tiny", "é"]
    at = lambda: r.choice([None, float("nan"), math.inf, -math.inf, 5.0, 5.0, r.random(), r.random() * 1e9, r.gauss(0, 1), float(r.randint(0, 40))])
    return [(r.choice(runs), at(), i, r.choice([None, r.random(), r.random() * 9, -1.0]), r.choice([None, r.randint(-9, 9)])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(random.Random(2), 1500) + [("one", 1.0, 9999, 4.0, 4)], SCHEMA).repartition(4).cache()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def collected(df, names):
    return [tuple(plain(x) for x in r) for r in df.select("id", *names).collect()]


@pytest.mark.parametrize("size", [3, 100_000])
def test_scans_equal_windows(table, size):
    order = [F.col("at"), F.col("id")]
    w = Window.partitionBy("run").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = scan.ranged(table, ["run"], "at", ["at", "id"], size)
    r = r.running(low=("min", "value"), high=("max", "value"), total=("sum", "n"), place=("count", None), some=("count", "n"))
    r = r.totals(size=None, all=("n")).shifted("two_before", "value", 2).shifted("next", "n", -1).shifted("far", "n", -7)
    want = table.select(
        "id", F.min("value").over(upto).alias("low"), F.max("value").over(upto).alias("high"), F.sum("n").over(upto).alias("total"), F.row_number().over(w).alias("place"), F.count("n").over(upto).alias("some"),
        F.count("*").over(Window.partitionBy("run")).alias("size"), F.sum("n").over(Window.partitionBy("run")).alias("all"), F.lag("value", 2).over(w).alias("two_before"), F.lead("n", 1).over(w).alias("next"), F.lead("n", 7).over(w).alias("far"),
    )
    names = want.columns[1:]
    assert sorted(collected(r.rows(), names), key=str) == sorted(collected(want, names), key=str)
    assert r.rows().columns == [*table.columns, "low", "high", "total", "place", "some", "size", "all", "two_before", "next", "far"]


def test_no_window_holds_a_run(spark):
    """Keys in clumps: a hot run is dealt by its ends, and cut at quantiles where ranges are too full."""
    d = spark.range(20_000).select(F.lit("hot").alias("run"), F.when(F.col("id") % 10 < 9, F.col("id") / 1e6).otherwise(F.col("id").cast("double")).alias("at"), "id")
    r = scan.ranged(d, ["run"], "at", ["at", "id"], 100)
    sizes = [x["count"] for x in r.dealt.groupBy(*r.keys).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * scan.FULL * 100
    got = r.running(place=("count", None)).rows()
    assert got.withColumn("want", F.row_number().over(Window.orderBy("at", "id"))).where("place <> want").count() == 0


def test_empty_and_global(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scan.ranged(none, ["run"], "at").running(x=("sum", "n")).shifted("y", "n", 1).rows().collect() == []
    d = spark.range(500).withColumn("v", F.col("id") * 3)
    got = scan.ranged(d, [], "id", rows=20).running(s=("sum", "v")).shifted("p", "v", 3).rows().orderBy("id").collect()
    assert [(x.s, x.p) for x in got] == [(3 * i * (i + 1) // 2, 3 * (i - 3) if i > 2 else None) for i in range(500)]


def test_early_stop_over_ranges(spark, monkeypatch):
    r = random.Random(7)
    values = [r.choice([None, 5.0, 5.0, 5.05, 5.2, 4.9, 9.0]) for _ in range(400)]
    best, bad, want = math.inf, 0, []
    for v in values:
        if v is not None:
            best = min(best, v)
        bad = bad + 1 if v is not None and v > best * 1.015 else 0
        want.append((None if best == math.inf else best, bad))
    d = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "r string, o long, v double")
    for size in (1, 13, 10_000):
        monkeypatch.setattr(scan, "ROWS", size)
        assert [(x.best, x.bad) for x in ledger.early_stop(d, "r", "o", "v", 1.015).orderBy("o").collect()] == want
    monkeypatch.setattr(scan, "ROWS", 7)
    e = {x.o: (x.is_first, x.is_last) for x in ledger.edges(d, "r", "o", 3).collect()}
    assert e == {i: (i < 3, i >= 397) for i in range(400)}


@pytest.mark.parametrize("margin", [6.0, 0.0, -3.0])
def test_bottom_rows_of_a_group(spark, monkeypatch, margin):
    """Groups with other wants each; a margin that is too small is made up for."""
    monkeypatch.setattr(sampling, "MARGIN", margin)
    monkeypatch.setattr(scan, "ROWS", 50)
    d = spark.range(4000).select(F.when(F.col("id") % 3 < 2, "big").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("mid").alias("g"), "id")
    monkeypatch.setattr(scan, "ROWS", 50)
    d = d.union(spark.createDataFrame([("few", -1), ("few", -1), ("few", None), ("no", 7)], "g string, id long"))
    k = F.when(F.col("g") == "big", 300).when(F.col("g") == "few", 2).when(F.col("g") == "no", 0).otherwise(17)
    got = sampling.per_group(d.withColumn("k", k), ["g"], "s", "id", F.col("k"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(sampling.order_key("s", F.col("id")), "id"))
    want = d.withColumn("k", k).withColumn("r", place).where("r <= k").drop("r")
    assert got.columns == ["g", "id", "k"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_group_sends_few_rows(spark):
    d = spark.range(200_000).select(F.lit("g").alias("g"), "id")
    got = sampling.per_group(d, ["g"], "s", "id", 10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_below" in plan and got.count() == 10
