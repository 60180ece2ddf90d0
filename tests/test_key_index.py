import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.operators import key_index as ki

SCHEMA = "source string, id long"


def test_filters_miss_nothing_and_pass_few():
    r = np.random.default_rng(1)
    h = r.integers(-(1 << 63), 1 << 63, 40_000)
    f = ki.bloom(h)
    assert ki.may_hold(f, h).all() and len(f) == 50_000
    assert ki.may_hold(f, r.integers(-(1 << 63), 1 << 63, 40_000)).mean() < 0.02
    assert not ki.may_hold(ki.bloom(h[:0]), h).any()


def test_files_grow_with_the_logarithm_of_batches():
    """A thousand batches: what a lookup reads, by the same rule that the index merges by."""
    runs, most, written = [], 0, 0
    for b in range(1000):
        runs.append({"level": 0, "batches": [b], "keys": 10})
        while due := ki.levels(runs, ki.FANOUT):
            merged = {"level": due[0]["level"] + 1, "batches": [x for r in due for x in r["batches"]], "keys": sum(r["keys"] for r in due)}
            written += merged["keys"]
            runs = [merged, *[r for r in runs if r not in due]]
        most = max(most, len(runs))
        assert sorted(x for r in runs for x in r["batches"]) == list(range(b + 1))
    depth = math.ceil(math.log(1000, ki.FANOUT))
    assert most <= (ki.FANOUT - 1) * depth and written <= 10 * 1000 * depth


@pytest.mark.parametrize("prefix", [500_000, 7])
def test_lookups_are_exact(spark, tmp_path, monkeypatch, prefix):
    """Batches with repeated and null keys, merges in between, prefixes of a few keys, one batch run again."""
    monkeypatch.setattr(ki, "PREFIX_KEYS", prefix)
    monkeypatch.setattr(ki, "FANOUT", 3)
    r, index, held = random.Random(prefix), ki.KeyIndex(spark, str(tmp_path / "keys"), StructType.fromDDL(SCHEMA)), set()
    assert index.known(spark.createDataFrame([("a", 1)], SCHEMA)).count() == 0
    for b in range(5):
        rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 60)])) for _ in range(r.choice([0, 12, 30]))]
        df = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit("x"))
        known = index.known(df, b)
        assert {tuple(x) for x in known.collect()} == held & set(rows) and known.columns == ["source", "id"]
        index.release()
        new = [k for k in set(rows) if k not in held]
        index.add(spark.createDataFrame(new, SCHEMA), b)
        if b == 4:  # it crashed and runs again: its own keys don't count, whatever it wrote
            assert {tuple(x) for x in index.known(df, b).collect()} == held & set(rows)
            index.add(spark.createDataFrame(new, SCHEMA), b)
        held |= set(new)
        assert sum(x["keys"] for x in index.runs()) == len(held)
    assert sorted(x for y in index.runs() for x in y["batches"]) == list(range(5)) and len(index.runs()) < 5
    everything = spark.createDataFrame(sorted(held, key=str) + [("new", 1)], SCHEMA)
    assert {tuple(x) for x in index.known(everything).collect()} == held
    assert len(index.vacuum(hours=0)) >= 3 and index.known(everything).count() == len(held)


def test_new_keys_read_no_run(spark, tmp_path):
    index = ki.KeyIndex(spark, str(tmp_path / "keys"), StructType.fromDDL("id long"))
    index.add(spark.range(1000), 0)
    found = index.known(spark.range(5000, 5003))
    assert "runs/" not in str(found.inputFiles()) and found.count() == 0


def test_filters_of_many_prefixes_are_many_tasks(spark, tmp_path, monkeypatch):
    """One task sorted the hashes of 64 prefixes, and a batch beside a small run was one group."""
    monkeypatch.setattr(ki, "PREFIX_KEYS", 50)
    real, seen = ki.bloom, tmp_path / "seen"
    seen.mkdir()

    def noted(h):
        from pyspark import TaskContext

        (seen / str(TaskContext.get().partitionId())).touch()
        return real(h)

    index = ki.KeyIndex(spark, f"file://{tmp_path}/few", StructType().add("id", "long"))
    index.add(spark.range(0, 4), 0)
    found = sorted(r.id for r in index.known(spark.range(1600), 1).collect())
    index.release()
    assert found == [0, 1, 2, 3]
    monkeypatch.setattr(ki, "bloom", noted)
    index = ki.KeyIndex(spark, f"file://{tmp_path}/many", StructType().add("id", "long"))
    assert index.add(spark.range(1600), 0)["runs"][0]["keys"] == 1600
    assert len(list(seen.iterdir())) > 8
