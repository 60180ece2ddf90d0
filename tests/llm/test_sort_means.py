import hashlib
import random

import duckdb
import numpy as np
import pytest

from loomspan.llm import sort_means as sm

SCHEMA = "vec_id long, embedding array<float>"


def brute_nearest(x, c):
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(-1)
    to = [min(range(len(c)), key=lambda j, row=row: (row[j], j)) for row in d]
    return to, [row[j] for row, j in zip(d, to, strict=True)]


@pytest.mark.parametrize("size", [2, 40, 5000, 1 << 23, 1 << 27])
def test_walk_against_all_centroids(size):
    """Small sizes give ties and equal centroids; large ones leave the range that doubles hold."""
    rng = np.random.default_rng(size)
    for k, dims in ((1, 3), (2, 1), (8, 2), (8, 64), (20, 5)):
        c = rng.integers(-size, size + 1, (k, dims))
        c[k // 2] = c[0]
        x = np.concatenate([rng.integers(-size, size + 1, (60, dims)), c]).astype(np.int32)
        to, far = sm.nearest(x, rng.integers(0, k, len(x)), c)
        want = brute_nearest(x, c)
        assert to.tolist() == want[0] and far.tolist() == [int(v) for v in want[1]]


def test_walk_stops_early(monkeypatch):
    seen = []
    own = sm.distances
    monkeypatch.setattr(sm, "distances", lambda x, c: seen.append(len(x)) or own(x, c))
    c = np.array([[0, 0], [1000, 0], [0, 1000], [5000, 5000]])
    x = np.tile([[3, 3]], (500, 1)).astype(np.int32)
    assert set(sm.nearest(x, np.zeros(500, int), c)[0].tolist()) == {0}
    assert seen[4:] == [500]  # after the centroids' own distances, only those to the centroid from before


def clusters(vectors, rounds=10, k=8):
    """The contract, vector by vector."""
    q = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in vectors]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    c = [v for _, _, v in sorted((name(i), np.array(w, np.float32).tolist(), v) for (i, v), (_, w) in zip(q, vectors, strict=True))[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in q]
        for j in set(at):
            own = [v for (_, v), a in zip(q, at, strict=True) if a == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, place(v)[1], place(v)[0]) for i, v in q), key=str), c


def test_odd_vectors(spark):
    r = random.Random(3)
    v = lambda: [r.choice([-0.5, 0.0, 0.25, 1.0, r.random()]) for _ in range(64)]
    same = v()
    good = [(i, v()) for i in range(150)] + [(None, v()), (None, same), (-4, same), (7, same), (7, v())] + [(1000 + i, same) for i in range(80)]
    bad = [(1, None), (2, []), (3, same[:63]), (4, [*same, 1.0]), (5, [None, *same[1:]]), (6, [float("nan"), *same[1:]]), (8, [float("-inf"), *same[1:]])]
    df = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "1 as key", "'x' as x", "2 as block").repartition(5)
    got, centroids = sm.cluster(df)
    want, c = clusters(good)
    assert sorted(map(tuple, got.collect()), key=str) == want and centroids.tolist() == c


def test_few_vectors_and_none(spark):
    few = [(i, [float(i)] * 64) for i in (5, 9)]
    got, c = sm.cluster(spark.createDataFrame(few, SCHEMA))
    assert sorted(tuple(r)[0::2] for r in got.collect()) == [(5, 0), (9, 0)] and len(c) == 2
    got, c = sm.cluster(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and len(c) == 0
    with pytest.raises(Exception, match="fit a long"):
        sm.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA))


def test_rounds_move_no_vectors(spark, sf_dir, monkeypatch):
    """The join of the vectors with what the round before wrote has no exchange."""
    plans = []
    own = sm._bucketed
    monkeypatch.setattr(sm, "_bucketed", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, n))
    sm.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=3)
    assert len(plans) == 4 and "Exchange" in plans[0]
    assert all("Exchange" not in p for p in plans[1:]) and "ShuffledHashJoin" in plans[2]


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = sm.query(spark, sf_dir)
    want = con.execute(sm.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
