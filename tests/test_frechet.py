import numpy as np
import pytest

from loomspan.plans import catalog


def test_frechet_distance_over_all_dimensions(spark, tmp_path):
    r = np.random.default_rng(6)
    x = {0: r.normal(size=(150, 12)), 1: r.normal(size=(120, 12)) * np.linspace(1, 3, 12) + np.linspace(0, 2, 12)}
    rows = [(n, label, v.tolist()) for label, m in x.items() for n, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (ma, sa), (mb, sb) = [(m.mean(0), np.cov(m.T)) for m in x.values()]
    values, vectors = np.linalg.eigh(sa)
    root = vectors * np.sqrt(values) @ vectors.T
    want = ((ma - mb) ** 2).sum() + np.trace(sa + sb) - 2 * np.sqrt(np.linalg.eigvalsh(root @ sb @ root)).sum()
    assert catalog.queries()["agg18_frechet"](spark, str(tmp_path)).first().frechet == pytest.approx(want, rel=1e-9)
    parts = catalog.queries()["agg18_frechet_parts"](spark, str(tmp_path)).where("label = 1").collect()
    assert len(parts) == 144 and all(abs(p.cov - sb[p.i, p.j]) < 1e-6 and abs(p.mean_i - mb[p.i]) < 1e-6 for p in parts)
