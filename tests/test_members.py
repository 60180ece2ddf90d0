"""Tar shards through marks: ranges, a stream that dies after every batch, late shards."""

import io
import random
import tarfile

import pytest
from pyspark.errors import StreamingQueryException

from loomspan.sources import members


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    """Three shards and an empty one, with long names, empty members and folders between them; {(shard file, name): bytes}."""
    r, where, want = random.Random(4), tmp_path_factory.mktemp("shards"), {}
    for s, n in enumerate((30, 0, 25, 7)):
        with tarfile.open(where / f"{s}.tar", "w") as tar:
            for k in range(n):
                if k % 6 == 0:
                    folder = tarfile.TarInfo(f"folder{k}")
                    folder.type = tarfile.DIRTYPE
                    tar.addfile(folder)
                name, body = ("long" * 60 if k % 5 == 0 else "m") + f"{k}.bin", r.randbytes(r.choice([0, 10, 700, 3000]))
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                want[f"{s}.tar", k, name] = body
    return where, want


def got(df):
    rows = [((r.archive.rsplit("/", 1)[-1], r.member, r.name), bytes(r.data)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_a_shard_is_read_by_several_tasks(spark, shards, tmp_path):
    where, want = shards
    marks = members.index(spark, str(where), f"{tmp_path}/marks", 9000).collect()
    assert sum(m.members for m in marks) == len(want) and len([m for m in marks if m.archive.endswith("0.tar")]) > 3
    assert max(m.end - m.begin for m in marks) < 9000 + 8192
    assert got(members.read(spark, f"{tmp_path}/marks")) == want
    assert members.index(spark, str(where), f"{tmp_path}/marks", 9000).count() == len(marks)  # known shards are not walked again


def test_a_shard_that_ends_early_is_named(spark, shards, tmp_path):
    where, _ = shards
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/broken.tar").write_bytes((where / "0.tar").read_bytes()[:30_000])
    with pytest.raises(Exception, match="broken.tar|unexpected end|truncated"):
        members.index(spark, f"{tmp_path}/cut", f"{tmp_path}/marks", 9000)


def test_every_member_once_whatever_batch_it_dies_in(spark, shards, tmp_path):
    where, want = shards
    members.index(spark, str(where), f"{tmp_path}/marks", 4000)
    died = []

    def run(fail: bool):
        frame = members.stream(spark, f"{tmp_path}/marks", f"{tmp_path}/progress", 12_000)

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
            if fail and number not in died:
                died.append(number)
                raise RuntimeError("killed")

        q = frame.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for _ in range(4):
        with pytest.raises(StreamingQueryException):
            run(True)
    run(False)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert got(out) == want and len(died) == 4 and out.select("batch").distinct().count() >= 5
    # Batches cut shards in the middle.
    assert out.where("archive like '%0.tar'").select("batch").distinct().count() > 1


def test_late_shards_are_taken_next(spark, shards, tmp_path):
    where, want = shards
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("2.tar", "3.tar"):
        (folder / name).write_bytes((where / name).read_bytes())
    go = lambda: members.drain(members.stream(spark, f"{tmp_path}/marks", f"{tmp_path}/progress", 50_000), f"{tmp_path}/out", f"{tmp_path}/cp")
    members.index(spark, str(folder), f"{tmp_path}/marks", 9000)
    go()
    first = got(spark.read.parquet(f"{tmp_path}/out"))
    assert first == {k: v for k, v in want.items() if k[0] in ("2.tar", "3.tar")}
    (folder / "0.tar").write_bytes((where / "0.tar").read_bytes())  # sorts before the others, comes after them
    members.index(spark, str(folder), f"{tmp_path}/marks", 9000)
    go()
    go()
    assert got(spark.read.parquet(f"{tmp_path}/out")) == want


def test_members_are_written_as_they_come(spark, tmp_path):
    """A task held its shard, 256 MB, until it was whole."""
    where, seen = tmp_path / "tars", tmp_path / "seen"

    def made(batches):
        import pyarrow as pa

        for k in range(60):
            written = sum(f.stat().st_size for f in where.iterdir()) if where.exists() else 0
            with open(seen, "a") as f:
                f.write(f"{written}\n")
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bytes([k]) * (1 << 20)])], ["id", "data"])

    rows = spark.range(1).coalesce(1).mapInArrow(made, "id long, data binary")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        members.write(rows, "id", "data", f"file://{where}")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert max(map(int, seen.read_text().split())) > 10 << 20
    members.index(spark, f"file://{where}", f"file://{tmp_path}/marks", 8 << 20)
    assert sorted((int(r.name), bytes(r.data)) for r in members.read(spark, f"file://{tmp_path}/marks").collect()) == [(k, bytes([k]) * (1 << 20)) for k in range(60)]
