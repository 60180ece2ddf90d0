import numpy as np
import pytest

from loomspan.plans import catalog


def test_dispersive_loss_of_every_batch(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.vec_id // 200, []).append(r.embedding)
    want = {}
    for b, v in batches.items():
        v = np.array(v, float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        e = -np.maximum(2 - 2 * v @ v.T, 0) / 0.5
        want[b] = np.log(np.exp(e[~np.eye(len(v), dtype=bool)]).mean())
    got = catalog.queries()["mth04_dispersive"](spark, sf_dir).collect()
    assert len(want) > 1 and {r.batch: r.loss for r in got} == pytest.approx(want, abs=2e-6)
