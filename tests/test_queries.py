"""Every reference query against its SQL twin at the smallest scale."""

import math
import os

import duckdb
import pytest

from loomspan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, key):
    df = catalog.queries()[key](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[key])
    found = [c[0] for c in cur.description]
    assert sorted(found) == names
    want = sorted(str([plain(r[found.index(c)]) for c in names]) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, key):
    assert catalog.queries()[key](spark, sf_dir).count() > 0


def test_pushed_filter_and_pruned_columns(spark, sf_dir):
    plan = catalog.queries()["flt02_scores"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,9)" in plan and "p_name" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
