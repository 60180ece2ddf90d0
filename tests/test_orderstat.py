import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import orderstat, scan


def test_quantiles_of_lopsided_groups(spark, monkeypatch):
    """Clumps, ties, nulls, null groups, infinities, groups of one; few cells make every round narrow."""
    monkeypatch.setattr(orderstat, "CELLS", 3)
    monkeypatch.setattr(scan, "ROWS", 20)
    r = random.Random(3)
    pick = lambda: r.choice([5.0, 5.0, 5.0, r.random(), r.random() * 1e-6, r.random() * 1e12, -r.random() * 1e3, float(r.randint(0, 9))])
    groups = {("a", 1): [pick() for _ in range(700)], (None, 1): [pick() for _ in range(41)], ("b", None): [2.5], ("c", 2): [7.0] * 90, ("inf", 0): [-math.inf, 1.0, 2.0, 3.0, math.inf]}
    rows = [(*g, v) for g, x in groups.items() for v in x] + [("a", 1, None)] * 30 + [("none", 0, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = {(x.g, x.h): x for x in orderstat.quantiles(df, ["g", "h"], "v", {"low": 0.0, "p": 0.31, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        want = [min(x), np.quantile([v for v in x], 0.31) if g[0] != "inf" else None, np.median(x), max(x)]
        for name, w in zip(("low", "p", "mid", "top"), want, strict=True):
            assert w is None or got[g][name] == pytest.approx(w, rel=1e-12)
    ranks = orderstat.at_ranks(df, ["g", "h"], "v", F.array(F.lit(0).cast("long"), F.lit(40).cast("long"), F.lit(5000).cast("long"))).collect()
    assert {(x.g, x.h, x.rank): x.value for x in ranks} == {(*g, k): sorted(v)[k] for g, v in groups.items() for k in (0, 40) if k < len(v)}
    assert orderstat.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).collect() == []
    whole = sorted(v for x in groups.values() for v in x)
    assert orderstat.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(whole))


def test_weights_are_resamples(spark):
    blocks, n, draws = 7, 100, 4000
    into = [orderstat.drawn_into(b, blocks, n, draws, 3, 16) for b in range(blocks)]
    assert (sum(into) == n).all()
    rows = np.array([16] * 6 + [4])
    assert np.allclose([x.mean() for x in into], rows, atol=0.3)
    assert np.allclose([x.var() for x in into], rows * (1 - rows / n), rtol=0.15)
    r = random.Random(1)
    values = [r.gauss(3, 2) for _ in range(n)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)] + [(500, None, None)], "k long, v double, one double")
    means = {x.draw: x["mean"] for x in orderstat.bootstrap(df.repartition(3), "k", "v", draws, 3, 16).collect()}
    again = {x.draw: x["mean"] for x in orderstat.bootstrap(df.coalesce(1), "k", "v", draws, 3, 16).collect()}
    assert sorted(means) == list(range(draws)) and means == pytest.approx(again)
    assert np.mean(list(means.values())) == pytest.approx(np.mean(values), abs=0.02)
    assert np.std(list(means.values())) == pytest.approx(np.std(values) / math.sqrt(n), rel=0.05)
    assert {round(x["mean"], 9) for x in orderstat.bootstrap(df, "k", "one", 50).collect()} == {1.0}
    assert orderstat.bootstrap(df.limit(0), "k", "v", 50).collect() == []
