import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.functions import images
from loomspan.operators import ingest, sampling
from loomspan.operators.store import Store


def filtered_png(pixels, kinds):
    """PNG with a given filter for each line, made the slow way."""
    h, w, n = pixels.shape
    raw, flat = b"", pixels.reshape(h, w * n).astype(int)
    for y, kind in zip(range(h), kinds, strict=True):
        line = []
        for x in range(w * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes([kind]) + bytes(int(v) for v in line)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_of_every_filter(n):
    x = np.random.default_rng(n).integers(0, 256, (5, 7, n)).astype(np.uint8)
    got = images.decode(filtered_png(x, [0, 1, 2, 3, 4]))
    assert (got == (np.repeat(x[:, :, :1], 3, axis=2) if n < 3 else x[:, :, :3])).all()


def test_png_round_trip_and_damage():
    x = np.random.default_rng(0).integers(0, 256, (9, 4, 3)).astype(np.uint8)
    data = images.to_png(x)
    assert images.probe(data) == ("png", 4, 9) and (images.decode(data) == x).all()
    with pytest.raises((ValueError, zlib.error)):
        images.decode(data[:50] + b"?" + data[51:])
    with pytest.raises(ValueError, match="unknown picture"):
        images.probe(b"none")


def test_sizes_from_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03"
    assert images.probe(jpeg) == ("jpeg", 40, 30)
    assert images.probe(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert images.probe(b"BM" + bytes(16) + struct.pack("<ii", 7, -8)) == ("bmp", 7, 8)
    assert images.probe(b"P6\n# c\n2 3\n255\n" + bytes(18)) == ("ppm", 2, 3)
    lossless = (16 - 1) | (9 - 1) << 14
    assert images.probe(b"RIFF    WEBPVP8L    \x2f" + struct.pack("<I", lossless) + bytes(9)) == ("webp", 16, 9)
    assert images.probe(b"RIFF    WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == ("webp", 100, 50)


def test_unreadable_pictures_are_rows_with_a_reason(spark):
    d = spark.createDataFrame([(1, bytearray(b"none")), (2, None), (3, bytearray(images.to_png(np.zeros((2, 3, 3), np.uint8)))), (4, bytearray(b""))], "id int, picture binary")
    got = {r.id: r for r in d.select("id", images.size_of("picture").alias("s"), images.rgb_of("picture").alias("p")).collect()}
    assert got[3].s.width == 3 and got[3].p.height == 2 and len(got[3].p.rgb) == 18 and got[3].s.error is None
    assert all(got[i].s.width is None and got[i].s.error and got[i].p.rgb is None and got[i].p.error for i in (1, 2, 4))


def test_perturbations():
    x = np.random.default_rng(3).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert all(f(x).shape == x.shape for f in images.PERTURBATIONS.values())
    assert images.blur(x, 2).astype(float).std() < x.astype(float).std() / 2
    assert (images.saturate(x, 1.0) == x).all() and np.ptp(images.saturate(x, 0.0).astype(int), axis=2).max() <= 1
    y, centre = 7, np.rint(x[5:10, 8:13].reshape(-1, 3).mean(axis=0))
    assert (images.blur(x, 2)[y, 10] == centre).all()
    assert (images.cover(x, 30, 20) == x).all() and images.cover(x, 10, 10).shape == (10, 10, 3)


def test_ordinals_with_nulls_and_ties(spark):
    rows = [(g, s, k) for g in ("a", None, "b") for s in (1, None) for k in (5, 5, None, -3, 10**12)]
    d = spark.createDataFrame(rows, "g string, s int, k long")
    got = sampling.ordinals(d, ["g"], ["s"], "k", "n").collect()
    for g in ("a", None, "b"):
        own = sorted((r.n, r.s, r.k) for r in got if r.g == g)
        assert [n for n, _, _ in own] == list(range(1, 11))
        assert [(s, k) for _, s, k in own] == [(s, k) for s in (None, 1) for k in (None, -3, 5, 5, 10**12)]
    assert sampling.ordinals(d.where("false"), ["g"], [], "k", "n").count() == 0


def test_command_line_ingest(spark, tmp_path):
    rows = [(f"p{i}", bytearray(images.to_png(np.full((64, 64 + i, 3), i, np.uint8))), f"caption {i}.", None) for i in range(5)]
    spark.createDataFrame([*rows, ("bad", bytearray(b"x"), "c", None)], "id string, picture binary, long string, short string").write.parquet(f"{tmp_path}/in")
    assert cli.main(["ingest", f"{tmp_path}/c", "--source", "own", "--input", f"{tmp_path}/in", "--short", "short", "--batch", "2"]) == 0
    s = Store(spark, f"{tmp_path}/c")
    assert {r.name: r.n for r in s.totals().collect()} == {"ok": 5, "failed": 1, "dropped": 0, "no_caption": 0}
    s.merge()
    assert s.rows().count() == 5 and all(len(r.latent) == 48 and r.val and r.short for r in s.rows().collect())


def test_mean_grid():
    x = np.zeros((10, 9, 3), np.uint8)
    x[:2, :2] = 255
    v = ingest.mean_grid([x])[0].reshape(4, 4, 3)
    assert (v[0, 0] == 1).all() and (v[1:] == -1).all()
