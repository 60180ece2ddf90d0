"""Pictures without an imaging library (SRC-20, MTH-15, UDF-11, PRJ-09): size probes, PNG and PPM to RGB, resizing, perturbations.

Sizes come from the headers of PNG, JPEG, WebP, GIF, BMP and PPM. Pixels are decoded here for PNG (8 bits, not interlaced) and
PPM; other kinds go to Pillow where it is installed, and are failures where it is not. A picture that can't be read is a
null with a reason, never an error of the job.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIDES = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
SIZE = T.StructType([T.StructField("kind", T.StringType()), *_SIDES, T.StructField("error", T.StringType())])
PIXELS = T.StructType([*_SIDES, T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def probe(data: bytes) -> tuple[str, int, int]:
    """(kind, width, height) from a picture's header."""
    if data[:8] == SIGNATURE and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:2] == b"P6":
        return "ppm", *_ppm(data)[:2]
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                break
            kind = data[at + 1]
            if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD9:  # fill bytes and marks without a body
                at += 1 if kind == 0xFF else 2
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise ValueError("unknown picture")


def _ppm(data: bytes) -> tuple[int, int, int]:
    """(width, height, place of the pixels); comments are passed over."""
    found, at = [], 2
    while len(found) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        found.append(int(data[at:end]))
        at = end
    if found[2] != 255:
        raise ValueError("not 8 bits")
    return found[0], found[1], at + 1


def to_png(pixels: np.ndarray) -> bytes:
    """8-bit RGB (height, width, 3) as PNG."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).copy()
        if kind == 1:
            line = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            values, up = line.tolist(), above.tolist()
            for x in range(stride):
                left = values[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - step] if x >= step else 0
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                values[x] = (values[x] + guess) & 255
            line = np.array(values, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3)."""
    kind, w, h = probe(data)
    if kind == "ppm":
        at = _ppm(data)[2]
        return np.frombuffer(data, np.uint8, w * h * 3, at).reshape(h, w, 3)
    if kind == "png":
        depth, colour, _, _, interlaced = data[24:29]
        if depth == 8 and not interlaced:
            at, body, palette = 8, [], None
            while at < len(data):
                size, name = struct.unpack(">I4s", data[at : at + 8])
                chunk = data[at + 8 : at + 8 + size]
                if len(chunk) != size or zlib.crc32(name + chunk) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
                    raise ValueError("damaged PNG")
                if name == b"IDAT":
                    body.append(chunk)
                elif name == b"PLTE":
                    palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
                at += 12 + size
            step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
            x = _unfiltered(zlib.decompress(b"".join(body)), h, w * step, step).reshape(h, w, step)
            if colour == 3:
                return palette[x[:, :, 0]]
            return np.repeat(x[:, :, :1], 3, axis=2) if step < 3 else x[:, :, :3]
    try:
        from PIL import Image
    except ImportError:
        raise ValueError(f"no decoder for this {kind}") from None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def cover(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized by nearest pixels so that the box is covered, then cut at the centre."""
    h, w, _ = pixels.shape
    s = max(width / w, height / h)
    nw, nh = max(width, round(w * s)), max(height, round(h * s))
    x = np.minimum((np.arange(nw) + 0.5) * w / nw, w - 1).astype(int)[(nw - width) // 2 :][:width]
    y = np.minimum((np.arange(nh) + 0.5) * h / nh, h - 1).astype(int)[(nh - height) // 2 :][:height]
    # The axis that leaves less goes first; take, unlike an index on the second axis, copies whole pixels in order.
    return pixels.take(x, axis=1).take(y, axis=0) if h < height else pixels.take(y, axis=0).take(x, axis=1)


def saturate(pixels: np.ndarray, factor: float) -> np.ndarray:
    """Colours moved away from grey (factor over 1) or towards it."""
    grey = (pixels @ np.array([0.299, 0.587, 0.114]))[:, :, None]
    return np.clip(np.rint(grey + (pixels - grey) * factor), 0, 255).astype(np.uint8)


def blur(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square around each pixel; edges repeat."""
    h, w, _ = pixels.shape
    n = 2 * radius + 1
    y, x = (np.arange(-radius, k + radius).clip(0, k - 1) for k in (h, w))
    total = np.zeros((h + n, w + n, 3), np.int64)
    total[1:, 1:] = pixels.take(y, axis=0).take(x, axis=1).cumsum(0, dtype=np.int64).cumsum(1)
    return np.rint((total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / n**2).astype(np.uint8)


def tile(pixels: np.ndarray, n: int) -> np.ndarray:
    """The picture, smaller, n x n times in its own size."""
    h, w, _ = pixels.shape
    small = cover(pixels, -(-w // n), -(-h // n))
    return np.tile(small, (n, n, 1))[:h, :w]


def noise(pixels: np.ndarray, deviation: float, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).normal(0, deviation, pixels.shape)
    return np.clip(np.rint(pixels + drawn), 0, 255).astype(np.uint8)


PERTURBATIONS = {"saturate": lambda x: saturate(x, 2.0), "blur": lambda x: blur(x, 2), "tile": lambda x: tile(x, 2), "noise": lambda x: noise(x, 25.0, 0)}


@F.pandas_udf(SIZE)
def size_of(pictures: pd.Series) -> pd.DataFrame:
    """SRC-20: kind and size from the header alone."""
    out = []
    for data in pictures:
        try:
            out.append((*probe(bytes(data)), None) if data is not None else (None, None, None, "null"))
        except (ValueError, IndexError, struct.error) as e:
            out.append((None, None, None, str(e)))
    return pd.DataFrame(out, columns=["kind", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(PIXELS)
def rgb_of(pictures: pd.Series) -> pd.DataFrame:
    """SRC-20: interleaved 8-bit RGB."""
    out = []
    for data in pictures:
        try:
            if data is None:
                raise ValueError("null")
            x = decode(bytes(data))
            out.append((x.shape[1], x.shape[0], x.tobytes(), None))
        except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error) as e:
            out.append((None, None, None, str(e)))
    return pd.DataFrame(out, columns=["width", "height", "rgb", "error"]).astype({"width": "Int32", "height": "Int32"})


def _changed(name: str, pixels: np.ndarray) -> bytes | None:
    """PNG of the perturbed pixels, null where they are too odd for it."""
    try:
        return to_png(PERTURBATIONS[name](pixels))
    except ValueError:
        return None


def _pixels(data: bytes | None) -> np.ndarray | None:
    try:
        return decode(bytes(data)) if data is not None else None
    except (ValueError, IndexError, struct.error, zlib.error):
        return None


def perturbed(name: str):
    """UDF-11: column function (picture) -> PNG of the perturbed picture, null where it can't be read."""

    @F.pandas_udf("binary")
    def run(pictures: pd.Series) -> pd.Series:
        return pictures.map(lambda data: None if (x := _pixels(data)) is None else _changed(name, x))

    return run


def all_perturbed(names: tuple[str, ...] = tuple(PERTURBATIONS)):
    """UDF-11: column function (picture) -> (name, picture) of each perturbation; a picture is decoded once for all."""

    @F.pandas_udf("array<struct<name:string,picture:binary>>")
    def run(pictures: pd.Series) -> pd.Series:
        found = (_pixels(data) for data in pictures)
        return pd.Series([[{"name": n, "picture": None if x is None else _changed(n, x)} for n in names] for x in found], dtype=object)

    return run
