"""STM-08: minutes that are reached to the very second."""

import functools

import duckdb
import pytest

from loomspan.operators import ledger, scan
from loomspan.plans import catalog


def test_sums_that_reach_the_minutes_exactly(spark):
    """Doubles add up to a bit less than 300, or more, by the order in which ranges are added."""
    values = (0.1, 0.3, 0.6, 0.7, 1.1, 1.2, 2.4, 4.8, 1.3, 0.9)
    steps = {v: [v] * (3000 if v < 1 else 600) for v in values}
    rows = [(str(v), i, x) for v, xs in steps.items() for i, x in enumerate(xs)]
    got = {(r.run, r.i): r.due_minutes for r in ledger.due(spark.createDataFrame(rows, "run string, i long, x double"), "run", "i", "x", 25, 5.0).collect()}
    for v, xs in steps.items():
        tenths = round(v * 10)
        for i in range(len(xs)):
            assert got[str(v), i] == (tenths * (i + 1) // 3000 > tenths * i // 3000), (v, i)


def test_odd_seconds(spark):
    rows = [("a", 0, None), ("a", 1, 400.0), ("a", 2, 1e12), ("a", 3, float("inf")), ("b", 0, None)]
    out = ledger.due(spark.createDataFrame(rows, "run string, i long, x double"), "run", "i", "x", 2, 5.0)
    assert out.columns == ["run", "i", "x", "step", "so_far", "due_steps", "due_minutes"]
    assert [(r.i, r.so_far) for r in out.where("run = 'a'").orderBy("i").collect()] == [(0, None), (1, 400.0), (2, 1e12 + 400), (3, float("inf"))]


@pytest.mark.parametrize("block", [4, 16])
def test_doubles_are_added_in_blocks(spark, monkeypatch, block):
    """Runs over all levels of blocks and several parts, of one row, of nulls alone and without a name; tenths reach 300 s to the second or nearly."""
    monkeypatch.setattr(scan, "BLOCK", block)
    values = {"a": (0.3, 5000), "b": (4.8, 513), "c": (2.4, 256), "d": (299.9, 1), None: (0.7, 700), "e": (None, 40)}
    rows = [(i * 7 + k, run, None if i % 50 == 3 else x) for k, (run, (x, n)) in enumerate(values.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, run string, x double")
    out = ledger.due(df, "run", "i", "x", 25, 5.0, doubles=True)
    assert out.columns == ["i", "run", "x", "step", "so_far", "due_steps", "due_minutes"]

    def added(a, b):
        return b if a is None else a if b is None else a + b

    @functools.cache
    def node(run, level, i):
        x = values[run][0]
        return (None if i % 50 == 3 else x) if not level else functools.reduce(added, (node(run, level - 1, j) for j in range(i * block, i * block + block)))

    def upto(run, n, level=0):
        start = upto(run, n // block, level + 1) if n >= block else None
        return functools.reduce(added, (node(run, level, j) for j in range(n // block * block, n)), start)

    for r in out.collect():
        k = r.step - 1
        assert r.i == k * 7 + list(values).index(r.run) and r.due_steps == (r.step % 25 == 0)
        so_far, was = upto(r.run, r.step), upto(r.run, k)
        assert r.so_far == so_far, (r, so_far)
        assert r.due_minutes == (None if so_far is None else so_far // 300 > (was or 0) // 300)


def test_cadence_at_size_equals_its_sql(spark, tmp_path):
    """Decimal sums of these seconds reach 300 s to the second where the SQL's doubles stay below it, or the other way round."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, ['click', 'error', 'view'][(i % 3) + 1] AS event_type, (i * 7919 % 1009) / 10 AS value FROM range(240000) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    names = ["event_id", "due_steps", "due_minutes"]
    got = catalog.queries()["stm08_cadence"](spark, str(tmp_path)).select(*names).toArrow()
    con.register("got", got)
    want = f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['stm08_cadence']})"
    assert con.execute(f"SELECT count(*) FROM ({want})").fetchone() == (got.num_rows,)
    assert con.execute(f"({want} EXCEPT FROM got) UNION ALL (FROM got EXCEPT {want})").fetchall() == []
