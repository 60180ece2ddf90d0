import gzip
import io
import json
import struct
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import models
from loomspan.sources import archives, fetch, files, tfrecord


def tar_bytes(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


ENTRIES = [("a/1.webp", b"P1"), ("a/1.json", b'{"id": 1}'), ("a/2.webp", b"P2"), ("a/3.png", b"P3"), ("a/3.json", b"{bad"), ("a/4.png", b"X"), ("a/4.jpg", b"P4"), ("a/4.txt", b"hello")]


def test_tar_pairs(spark, tmp_path):
    archives.register(spark)
    data = tar_bytes(ENTRIES)
    (tmp_path / "x.tar").write_bytes(data)
    (tmp_path / "y.tar.gz").write_bytes(gzip.compress(data))
    rows = spark.read.format("loomspan_tar_pairs").option("path", str(tmp_path)).load().collect()
    assert sorted((r.archive[-1], r.key, r.kind, bytes(r.picture), r.text) for r in rows) == [(z, "1", "webp", b"P1", '{"id": 1}') for z in "rz"]


def test_pairs_meet_wherever_they_stand():
    files = [("x/a.webp", b"A"), ("x/b.webp", b"B"), ("y/a.json", b"{}"), ("y/b.json", b'{"k": 1}'), ("c.json", b"{}")]
    assert list(archives.pairs(iter(files))) == [("a", "webp", b"A", "{}"), ("b", "webp", b"B", '{"k": 1}')]


def test_tar_head_keeps_every_picture_and_drops_the_cut_member(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "x.tar").write_bytes(tar_bytes([*ENTRIES, ("5.png", b"b" * 4000), ("5.txt", b"u")]))
    rows = spark.read.format("loomspan_tar_pairs").option("path", str(tmp_path)).option("headBytes", 10_000).load().collect()
    assert sorted((r.key, r.kind, r.text) for r in rows) == [("1", "webp", '{"id": 1}'), ("2", "webp", "{}"), ("3", "png", "{}"), ("4", "jpg", '{"txt": "hello"}')]


def test_a_fault_inside_an_archive_is_an_error():
    class Broken(io.BytesIO):
        def read(self, n=-1):
            if self.tell() > 3000:
                raise OSError("gone")
            return super().read(n)

    data = tar_bytes([(f"{i}.webp", b"x" * 600) for i in range(30)])
    with pytest.raises(OSError, match="gone"):
        list(archives.members(Broken(data), False))
    with pytest.raises((tarfile.ReadError, EOFError)):
        list(archives.members(io.BytesIO(data[:2000]), False))
    assert len(list(archives.members(io.BytesIO(data[:2000]), False, head=True))) == 1


def test_zip_members_by_ranges(spark, tmp_path):
    archives.register(spark)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(20):
            z.writestr(f"{i}.bin", bytes([i]) * 100)
    reader = spark.read.format("loomspan_zip").option("path", str(tmp_path)).option("rangeBytes", 250)
    assert reader.load().rdd.getNumPartitions() == 7
    assert {r.name: bytes(r.data) for r in reader.load().collect()} == {f"{i}.bin": bytes([i]) * 100 for i in range(20)}


def test_tar_json_and_zip_with_fallback(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "x.tar").write_bytes(tar_bytes([("1.json", b'{"k": 1}'), ("2.json", b"{"), ("3.txt", b"t")]))
    assert [r.name for r in spark.read.format("loomspan_tar_json").option("path", str(tmp_path)).load().collect()] == ["1.json"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.jpg", b"A")
    zipped = spark.read.format("loomspan_zip").option("path", str(tmp_path)).load()
    wanted = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "name string")
    got = archives.with_fallback(wanted, zipped, spark.createDataFrame([("b.jpg", bytearray(b"B"))], "name string, data binary")).collect()
    assert {r.name: r.data and bytes(r.data) for r in got} == {"a.jpg": b"A", "b.jpg": b"B", "c.jpg": None}


def _tag(field, kind, body):
    return bytes([field << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)


def _example(packed):
    bytes_list = _tag(1, 2, _tag(1, 2, b"hi"))
    floats = struct.pack("<2f", 1.5, -2.0)
    float_list = _tag(2, 2, _tag(1, 2, floats) if packed else _tag(1, 5, floats[:4]) + _tag(1, 5, floats[4:]))
    minus = b"\xff" * 9 + b"\x01"
    int_list = _tag(3, 2, _tag(1, 2, b"\x07" + minus) if packed else _tag(1, 0, b"\x07") + _tag(1, 0, minus))
    entries = b"".join(_tag(1, 2, _tag(1, 2, k) + _tag(2, 2, v)) for k, v in ((b"b", bytes_list), (b"f", float_list), (b"i", int_list)))
    return _tag(1, 2, entries)


@pytest.mark.parametrize("packed", [True, False])
def test_tfrecord(spark, tmp_path, packed):
    data = _example(packed)
    record = struct.pack("<Q", len(data)) + b"\0" * 4 + data + b"\0" * 4
    (tmp_path / "x.tfrecord").write_bytes(record * 2 + record[:-9])
    tfrecord.register(spark)
    rows = spark.read.format("loomspan_tfrecord").option("path", str(tmp_path)).load().collect()
    assert len(rows) == 6 and {r.record for r in rows} == {0, 1}
    of = {r.name: r for r in rows if r.record == 0}
    assert bytes(of["b"].b[0]) == b"hi" and of["f"].f == [1.5, -2.0] and of["i"].i == [7, -1]
    spark.createDataFrame([(bytearray(data),), (None,)], "d binary").createOrReplaceTempView("raw_examples")
    assert spark.sql("SELECT e.name FROM raw_examples, LATERAL example_features(d) e").count() == 3


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{bad\n{"k": 2}\n{"k": 3}')
    assert [r.k for r in files.json_lines_head(spark, str(tmp_path / "a.jsonl"), "k int", 10_000).collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert sorted(r.k for r in files.json_lines(spark, str(tmp_path / "b.jsonl"), "k int").collect()) == [1, 2]
    assert {r.run for r in files.run_logs(spark, str(tmp_path / "b*.jsonl"), "k int").collect()} == {"b"}


def test_nested_json_and_prompts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "width": 3}], "annotations": [{"image_id": 1, "caption": "x"}, {"image_id": 1, "caption": "y"}]}, indent=1))
    images, notes = files.nested_json(spark, str(tmp_path / "c.json"))
    assert images.join(notes, images.id == notes.image_id).count() == 2
    (tmp_path / "p.txt").write_text(" one \n\n two\n")
    assert sorted(r.prompt for r in files.prompt_lines(spark, str(tmp_path / "p.txt")).collect()) == ["one", "two"]


def test_parquet_peek_and_row_group_sample(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": list(range(100)), "b": ["x"] * 100}), tmp_path / "t.parquet", row_group_size=25)
    r = files.parquet_peek(spark, str(tmp_path)).first()
    assert (r.n_rows, r.row_groups, r.columns) == (100, 4, 2) and r.bytes > 0
    files.register(spark)
    rows = spark.read.format("loomspan_row_group").option("path", str(tmp_path)).option("seed", "3").option("columns", "a").load().collect()
    assert len(rows) == 25 and len({x.row_group for x in rows}) == 1 and json.loads(rows[0].row).keys() == {"a"}


def test_numpy_arrays(spark, tmp_path):
    np.savez(tmp_path / "x.npz", images=np.arange(6).reshape(3, 2), other=np.zeros(2))
    rows = files.numpy_arrays(spark, str(tmp_path), ["images"]).orderBy("row").collect()
    assert [r["values"] for r in rows] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_fetch_retries_and_gives_up():
    waits, calls = [], []

    class Gone(Exception):
        code = 404

    def flaky(url):
        calls.append(url)
        if url == "gone":
            raise Gone
        if len(calls) < 3:
            raise OSError("down")
        return b"ok"

    assert fetch.attempt(flaky, "x", waits.append) == (b"ok", None) and waits == [1.5, 3.0]
    calls.clear()
    assert fetch.attempt(flaky, "gone", waits.append)[0] is None and len(calls) == 1
    assert fetch.attempt(flaky, None)[1] == "no url"


def test_fetched_keeps_bad_items(spark):
    def get(url):
        if "bad" in url:
            raise ValueError("no")
        return url.encode()

    rows = fetch.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), "url", 2, get).collect()
    assert {r.url: (r.data and bytes(r.data), r.error) for r in rows} == {"a": (b"a", None), "bad": (None, "ValueError: no")}


def test_model_contracts(spark):
    def _factory():
        return lambda pictures, prompts: [len(p) + len(q) for p, q in zip(pictures, prompts, strict=True)]

    d = spark.createDataFrame([(bytearray(b"abc"), "xy"), (bytearray(b""), "z")], "p binary, q string")
    assert [r.s for r in d.select(models.scorer(_factory)("p", "q").alias("s")).collect()] == [5.0, 1.0]
    y = spark.range(1).select(models.yes_probability(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(1.0))).alias("y")).first().y
    assert y == pytest.approx(0.5)
    pixels = np.zeros((4, 5, 3), np.uint8)
    pixels[..., 0] = 255
    s = spark.createDataFrame([(bytearray(pixels.tobytes()), 4, 5)], "x binary, h int, w int").select(models.pixel_stats("x", "h", "w").alias("s")).first().s
    assert s.sat == 1.0 and s.sharp == 0.0 and s.contrast == pytest.approx(0)
    shaped = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "s string, v double")
    g = models.by_shape(shaped, "s", lambda f: pd.DataFrame({"v": f["v"] * 2}), "v double")
    assert sorted(r.v for r in g.collect()) == [2.0, 4.0, 6.0]
