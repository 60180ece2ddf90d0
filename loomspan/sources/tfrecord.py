"""TFRecord files of tf.train.Example (SRC-11, UDTF-01), read from the public wire formats alone.

Record: length (u64), checksum of it (u32), data, checksum of that (u32); checksums are not checked, and a truncated last
record is left out. Example: field 1 = Features, its field 1 = map entries (1 = key, 2 = Feature), and a Feature is a
bytes list (1), float list (2) or integer list (3); numbers are packed or not.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.functions import udtf

from .archives import _File, listed, opened

SCHEMA = "name string, kind string, b array<binary>, f array<float>, i array<long>"


def records(stream) -> Iterator[bytes]:
    while len(head := stream.read(12)) == 12:
        (size,) = struct.unpack("<Q", head[:8])
        data = stream.read(size)
        if len(data) < size or len(stream.read(4)) < 4:
            return
        yield data


class Wire:
    """Cursor over protocol-buffer bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        out = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    def fields(self) -> Iterator[tuple[int, int, bytes | int]]:
        """(field, wire type, value) of each field: bytes for types 1, 2 and 5, a number for type 0."""
        while self.at < len(self.data):
            tag = self.number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, kind, self.number()
                continue
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size = self.number()
            if size is None:
                raise ValueError(f"wire type {kind}")
            yield tag >> 3, kind, self.data[self.at : self.at + size]
            self.at += size


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def feature(data: bytes) -> tuple[str, list[bytes], list[float], list[int]]:
    raw: list[bytes] = []
    floats: list[float] = []
    ints: list[int] = []
    name = "empty"
    for which, _, body in Wire(data).fields():
        name = {1: "bytes", 2: "float", 3: "int"}.get(which, "unknown")
        for field, kind, value in Wire(body).fields():
            if field != 1:
                continue
            if which == 1:
                raw.append(value)
            elif which == 2:
                floats += struct.unpack(f"<{len(value) // 4}f", value)
            elif kind == 0:
                ints.append(_signed(value))
            else:
                packed = Wire(value)
                while packed.at < len(value):
                    ints.append(_signed(packed.number()))
    return name, raw, floats, ints


def example(data: bytes) -> Iterator[tuple[str, str, list[bytes], list[float], list[int]]]:
    for field, _, features in Wire(data).fields():
        if field == 1:
            for entry, _, item in Wire(features).fields():
                if entry == 1:
                    parts = {f: v for f, _, v in Wire(item).fields()}
                    yield parts.get(1, b"").decode(), *feature(parts.get(2, b""))


@udtf(returnType=SCHEMA)
class ExampleFeatures:
    """Lateral table function: features of one serialised Example."""

    def eval(self, data: bytes):
        if data is not None:
            yield from example(bytes(data))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_File(u) for u in listed(self.options["path"], (".tfrecord", ".tfrecords"))]

    def read(self, partition):
        if partition is not None:
            head = self.options.get("headbytes")
            for k, data in enumerate(records(opened(partition.uri, int(head) if head else None))):
                for row in example(data):
                    yield (partition.uri, k, *row)


class TFRecords(DataSource):
    """A row per feature. Options: path, headBytes."""

    @classmethod
    def name(cls):
        return "loomspan_tfrecord"

    def schema(self):
        return f"file string, record long, {SCHEMA}"

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecords)
    spark.udtf.register("example_features", ExampleFeatures)
