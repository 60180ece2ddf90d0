import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.operators.log import Conflict, Log
from loomspan.operators.store import Store, log_row
from loomspan.streaming import early_stop, ingest


def staged(spark, source, n, bucket="1_1"):
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit(source), F.col("id").cast("string")).alias("id"), F.lit(bucket).alias("bucket"), (F.col("id") < 2).alias("val"), F.lit(0.1).alias("crop"), F.array(F.col("id").cast("float"), F.lit(2.0).cast("float")).alias("latent"))


def test_merge_append_and_guard(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    s.stage(staged(spark, "b", 5), "b")
    s.stage(staged(spark, "a", 3), "a")
    s.stage(staged(spark, "a", 2, "4_3"), "a")
    s.stage(staged(spark, "x", 4), "x")
    m = s.merge(exclude=("x",), stats_rows=1000)
    assert m["merged"] == ["a", "b"] and len(m["mean"]) == 2 and m["mean"][1] == pytest.approx(2.0) and m["std"][1] == pytest.approx(1e-4)
    order = [r.ingest_source for r in s.rows().where("bucket = '1_1'").orderBy("row_no").collect()]
    assert order == ["a"] * 3 + ["b"] * 5
    with pytest.raises(ValueError, match="merged already"):
        s.append("a")
    late = s.append("x")
    assert late["mean"] == m["mean"] and late["merged"] == ["a", "b", "x"]
    assert all(r.whole for r in s.check().collect()) and s.rows().count() == 14
    assert s.append("a", force=True)["merged"] == ["a", "b", "x", "a"]
    assert cli.main(["check", str(tmp_path / "c")]) == 0


def test_rows_without_their_manifest_do_not_count(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        s.rows()
    s.stage(staged(spark, "a", 3), "a")
    s.merge()
    staged(spark, "z", 9).withColumns({"ingest_source": F.lit("z"), "at": F.col("seq")}).write.partitionBy("bucket").parquet(f"{tmp_path}/c/rows/part=lost")
    staged(spark, "y", 9).withColumn("ingest_source", F.lit("y")).write.partitionBy("ingest_source", "bucket").parquet(f"{tmp_path}/c/staging/load=cut")
    (tmp_path / "c/staging/load=cut/_SUCCESS").unlink()
    assert s.rows().count() == 3 and s.staged().count() == 3
    assert s.vacuum() == [] and s.vacuum(hours=0) == ["lost"] and s.rows().count() == 3


def test_a_crash_before_the_log(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "c"))
    s.stage(staged(spark, "a", 3), "a")
    s.merge()
    s.stage(staged(spark, "b", 4), "b")
    with monkeypatch.context() as m:
        m.setattr(Log, "created", lambda self, entry: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            s.append("b")
    assert s.versions() == [1] and s.rows().count() == 3
    assert s.append("b")["version"] == 2 and s.rows().count() == 7 and all(r.whole for r in s.check().collect())
    assert len(s.vacuum(hours=0)) == 1 and s.rows().count() == 7


def test_concurrent_writers(spark, tmp_path):
    """Appends of other sources all land, with whole places; of one source one lands; a merge over a commit is refused."""
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path / "c"))
    for name, n in (("a", 5), ("b", 4), ("c", 3), ("d", 2)):
        s.stage(staged(spark, name, n), name)
    s.merge(exclude=("b", "c", "d"), stats_rows=10)
    old = {(r.id, r.row_no) for r in s.rows().collect()}

    def go(name):
        try:
            return Store(spark, s.root).append(name)["version"]
        except Conflict as e:
            return str(e)

    with ThreadPoolExecutor(5) as pool:
        out = list(pool.map(go, ["b", "c", "d", "b", "c"]))
    assert sorted(x for x in out if isinstance(x, int)) == [2, 3, 4] and all("merged already" in x for x in out if isinstance(x, str))
    rows = {(r.id, r.row_no) for r in s.rows().collect()}
    assert sorted(n for _, n in rows) == list(range(14)) and old <= rows and all(r.whole for r in s.check().collect())
    # Versions are snapshots, and their rows keep their places.
    assert {(r.id, r.row_no) for r in s.rows(1).collect()} == old
    for v in (2, 3):
        assert {(r.id, r.row_no) for r in s.rows(v).collect()} <= rows
    with pytest.raises(FileNotFoundError, match="no version 9"):
        s.rows(9)

    own = Store._written

    def meanwhile(self, placed):
        made = own(self, placed)
        Store._written = own
        Store(spark, s.root).append("a", force=True)
        return made

    Store._written = meanwhile
    try:
        with pytest.raises(Conflict, match="while this merge ran"):
            s.merge()
    finally:
        Store._written = own
    assert s.manifest()["version"] == 5


def test_one_writer_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path / "c"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: s.log.created({"version": 1 + k % 3, "writer": k}), range(24)))
    assert sum(won) == 3 and s.versions() == [1, 2, 3]
    assert won[s.manifest(2)["writer"]] and not [n for n in (tmp_path / "c/log").iterdir() if not n.name.endswith((".json", ".crc"))]


def test_progress_and_log(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    s.progress("a", {"ok": 3})
    s.progress("a", {"ok": 4, "failed": 1})
    assert {r.name: r.n for r in s.totals().collect()} == {"ok": 7, "failed": 1}
    for k in range(2):
        log_row(spark.createDataFrame([(k,)], "step int"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_stream_takes_each_row_once_and_resumes(spark, tmp_path):
    schema = "id long, kind string"
    d = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(20)], schema)
    d.where("id < 10").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    d.where("id >= 5").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    calls = []
    go = lambda: ingest.run(spark, f"{tmp_path}/in", d.schema, f"{tmp_path}/out", f"{tmp_path}/cp", F.col("kind") == "good", ["id"], 1, calls.append)
    go()
    assert sorted(r.id for r in spark.read.schema(d.schema).parquet(f"{tmp_path}/out/rows/*").collect()) == [i for i in range(20) if i % 5]
    n = len(calls)
    go()  # nothing new: nothing happens
    assert len(calls) == n >= 2
    d.where("id < 3").selectExpr("id + 100 as id", "kind").write.parquet(f"{tmp_path}/in/3")
    go()
    assert spark.read.schema(d.schema).parquet(f"{tmp_path}/out/rows/*").count() == 18


def test_stream_state_equals_the_batch(spark, tmp_path):
    from loomspan.operators.ledger import early_stop as batch

    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 5.2, 5.3, 4.0, 4.2, 4.3])], "run string, step long, value double")
    for k in range(2):
        d.where(F.floor(F.col("step") / 3) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    early_stop.track(stream, 1.015).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.step, r.best, r.bad) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.step, r.best, r.bad) for r in batch(d, "run", "step", "value", 1.015).collect())
    assert got == want
