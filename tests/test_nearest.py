import numpy as np

from loomspan.operators import nearest


def test_blocks_of_queries(spark):
    """Queries in several blocks, each found against all vectors; null vectors match nothing."""
    r = np.random.default_rng(5)
    x = r.normal(size=(130, 6)).round(2)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = {}
    for q in nearest.top(df.where("id % 4 = 0"), df, "id", "v", 3, block=7).collect():
        got.setdefault(q.qid, []).append((-q.sim, q.vec_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {i: sorted((-sims[i, j], j) for j in range(130) if j != i)[:3] for i in range(0, 130, 4)}
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
