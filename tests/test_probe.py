import numpy as np
import pytest

from loomspan.operators import probe


def test_probe_equals_plain_training(spark):
    """Weights by Newton steps over the same standardised features and ridge."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5)) * np.arange(1, 6) + 2
    y = (x @ np.array([1.0, -0.5, 0.2, 0.0, 0.3]) + r.normal(size=400) > 2.5).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y double")
    model = probe.fit(df, "v", "y")
    z = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-6)
    a, w = np.column_stack([z, np.ones(len(z))]), np.zeros(6)
    ridge = np.diag([probe.RIDGE] * 5 + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge, a.T @ (p - y) / len(a) + ridge @ w)
    assert np.allclose([*model.weights, model.bias], w, atol=1e-3)
    got = {s.id: s.p for s in model.score(df, "v").collect()}
    assert [got[i] for i in range(400)] == pytest.approx((1 / (1 + np.exp(-a @ w))).tolist(), abs=1e-3)
