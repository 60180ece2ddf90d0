import hashlib
import itertools
from statistics import mean

import numpy as np
import pytest

from loomspan.plans import catalog


def test_passes_over_all_events_of_a_user(spark, tmp_path):
    scores = {1: [10, 20, 30, 40, 50, 50, 60, 70, 80], 2: [60, 70, 20, 10], 3: [51, 1, 2, 3, 4], 4: [90, 95], 5: [10, 20, 30]}
    rows = [(i, u, float(v)) for i, (u, v) in enumerate((u, v) for u, x in scores.items() for v in x)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = lambda key: sorted(map(tuple, catalog.queries()[key](spark, str(tmp_path)).collect()))
    p4 = {u: mean(max(x) > 50 for x in itertools.combinations(v, 4)) for u, v in scores.items() if len(v) >= 4}
    assert got("agg19_passk") == [(u, pytest.approx(p, abs=1e-9)) for u, p in p4.items()]
    assert got("agg19_passk_families") == [(f, pytest.approx(mean(p for u, p in p4.items() if u % 3 == f), abs=1e-9)) for f in (0, 1, 2)]
    assert got("agg20_softbest") == [(u, pytest.approx(mean(max(x) for x in itertools.combinations(v, 3)), abs=1e-6)) for u, v in scores.items() if len(v) >= 3]
    shares = [mean(x > 50 for x in v) for v in scores.values()]
    assert got("agg21_counts") == [(1, 1, pytest.approx(mean(shares), abs=1e-9))]


def test_bootstrap_of_all_users(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    users = sorted({e.user_id for e in events})
    side = lambda u, k: [e.value for e in events if e.user_id == u and e.event_id % 2 == k]
    gain = [mean(side(u, 0)) - mean(side(u, 1)) for u in users if side(u, 0) and side(u, 1)]
    draw = lambda b, j: int(int(hashlib.md5(f"{b}/{j}".encode()).hexdigest()[:13], 16) / 2**52 * len(gain))
    means = [mean(gain[draw(b, j)] for j in range(len(gain))) for b in range(1000)]
    assert tuple(catalog.queries()["agg23_bootstrap"](spark, sf_dir).first()) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)
    r = np.random.default_rng(5)
    own = np.array(gain)[r.integers(0, len(gain), (10_000, len(gain)))].mean(axis=1)
    got = catalog.queries()["agg23_bootstrap_weights"](spark, sf_dir).first()
    assert (got.lo, got.mid, got.hi) == pytest.approx(tuple(np.quantile(own, [0.025, 0.5, 0.975])), abs=0.15 * own.std())
