"""Gram matrices and pair sums against numpy."""

import numpy as np
import pytest

from loomspan.operators import gram


def test_groups_of_odd_shapes(spark):
    """Null keys and vectors, a group of one, blocks of a row, matrices sent again and again."""
    r = np.random.default_rng(1)
    data = {("a", 1): r.normal(size=(300, 9)) + 5, (None, 2): r.normal(size=(40, 9)), ("a", None): r.normal(size=(1, 4))}
    rows = [(*k, v.tolist()) for k, m in data.items() for v in m] + [("a", 1, None)] * 5
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(7)
    got = {}
    for x in gram.moments(df, ["g", "h"], "v", 100, 0).collect():
        got.setdefault((x.g, x.h), {})[x.i, x.j] = x
    for k, m in data.items():
        d = m.shape[1]
        assert len(got[k]) == d * d
        for (i, j), x in got[k].items():
            assert x.n == len(m) and x.mean_i == pytest.approx(m.mean(0)[i])
            assert x.cov is None if len(m) == 1 else x.cov == pytest.approx(np.cov(m.T)[i, j])
    n, mean, cov = gram.matrices(df.where("h = 1"), [], "v")[()]
    assert n == 300 and np.allclose(mean, data["a", 1].mean(0)) and np.allclose(cov, np.cov(data["a", 1].T))
    assert gram.moments(df.limit(0), ["g"], "v").collect() == []
    with pytest.raises(Exception, match="several lengths"):
        gram.matrices(df.where("g = 'a'"), ["g"], "v")


def test_a_thousand_dimensions_explode_no_rows(spark):
    d = 1024
    rows = np.random.default_rng(2).normal(size=(60, d))
    df = spark.createDataFrame([(v.tolist(),) for v in rows], "v array<double>").repartition(5)
    made = gram.gram(df, [], "v")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert made.count() == -(-d // (gram.BLOCK_BYTES // (8 * (d + 1))))
    n, mean, cov = gram.matrices(df, [], "v")[()]
    assert n == 60 and np.allclose(mean, rows.mean(0)) and np.allclose(cov, np.cov(rows.T))


def test_pairs_of_a_large_batch(spark):
    """A batch of several blocks, a null batch, repeated keys (no pair of their own) and zero vectors."""
    r = np.random.default_rng(3)
    rows = [(1, i % 90, v) for i, v in enumerate(r.normal(size=(120, 5)).tolist())] + [(None, i, v) for i, v in enumerate(r.normal(size=(7, 5)).tolist())]
    rows += [(2, 1, [0.0] * 5), (2, 2, [1.0] * 5), (3, 1, [1.0] * 5), (4, None, None)]
    want = {}
    for b in (1, None, 2):
        keys = np.array([k for g, k, _ in rows if g == b])
        x = np.array([v for g, _, v in rows if g == b])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        e = np.exp(-np.maximum(2 - 2 * x @ x.T, 0) / 0.5)
        want[b] = np.log(e[keys[:, None] != keys[None]].mean())
    got = gram.dispersive(spark.createDataFrame(rows, "b int, k long, v array<double>").repartition(4), "b", "k", "v", 0.5, 16).collect()
    assert {x.batch: x.loss for x in got} == pytest.approx(want)
