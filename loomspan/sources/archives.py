"""Archive sources (SRC-06..09): tar pairs, tars of JSON records and zip members, as Spark data sources.

One partition a tar, read as a stream, so a head of a few megabytes costs a few megabytes; zips are read by ranges of members.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .remote import filesystem

# Picture kinds by priority.
PICTURES = ("jpg", "jpeg", "png", "webp")
#: Compressed bytes of zip members that one task reads.
ZIP_BYTES = 64 << 20


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """SRC-14: URIs below a folder (or the file itself), filtered by suffix and sorted."""
    from pyarrow import fs

    uri = path if "://" in path else "file://" + os.path.abspath(path)
    system, base = filesystem(uri)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [uri]
    scheme = uri[: len(uri) - len(base)] if uri.endswith(base) else uri.split("://", 1)[0] + "://"
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes))


def opened(uri: str, head: int | None = None):
    """A readable stream of a file, or of its first `head` bytes."""
    system, base = filesystem(uri)
    stream = system.open_input_stream(base, compression=None)
    return io.BytesIO(stream.read(head)) if head else stream


def seekable(uri: str):
    system, base = filesystem(uri)
    return system.open_input_file(base)


class _Info(tarfile.TarInfo):
    """A header that ends early is an error; tarfile takes it for the archive's end."""

    @classmethod
    def fromtarfile(cls, tar):
        try:
            return super().fromtarfile(tar)
        except tarfile.TruncatedHeaderError as e:
            raise tarfile.ReadError(str(e)) from None


def members(stream, gz: bool, head: bool = False) -> Iterator[tuple[str, bytes]]:
    """Files of a tar in order. Only the head of a tar may end inside a member, which is then left out; a whole one that does is an error."""
    try:
        with tarfile.open(fileobj=stream, mode="r|gz" if gz else "r|", tarinfo=_Info) as tar:
            for m in tar:
                if m.isfile():
                    data = tar.extractfile(m).read()
                    if len(data) != m.size:
                        raise EOFError(f"{m.name}: {len(data)} of {m.size} bytes")
                    yield m.name, data
    except (tarfile.ReadError, EOFError, zlib.error, gzip.BadGzipFile):
        if not head:
            raise


def _stem(name: str) -> tuple[str, str]:
    """(base name without its last suffix, suffix in lower case)."""
    stem, _, kind = name.rsplit("/", 1)[-1].rpartition(".")
    return stem, kind.lower()


def pairs(files: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, str, bytes, str]]:
    """SRC-07: (key, kind, picture, text) as soon as a key has a picture and its JSON, wherever in the archive they stand.

    A key is the base name. A pair with broken JSON is left out, and so is what stays incomplete, which is held until the
    archive ends. The best kind of picture that stands before the pair is complete wins.
    """
    held: dict[str, dict[str, bytes]] = {}
    for name, data in files:
        key, kind = _stem(name)
        if kind not in PICTURES and kind != "json":
            continue
        of = held.setdefault(key, {})
        of[kind] = data
        picture = next((k for k in PICTURES if k in of), None)
        if picture and "json" in of:
            del held[key]
            try:
                text = of["json"].decode()
                json.loads(text)
            except ValueError:
                continue
            yield key, picture, of[picture], text


def pictures(files: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, str, bytes, str]]:
    """SRC-08: (key, kind, picture, text) of every picture of an archive's head, with its JSON, or its plain text as JSON {"txt": ...}, or {}."""
    held: dict[str, dict[str, bytes]] = {}
    for name, data in files:
        key, kind = _stem(name)
        held.setdefault(key, {})[kind] = data
    for key, of in held.items():
        picture = next((k for k in PICTURES if k in of), None)
        if picture is None:
            continue
        text = "{}"
        if "json" in of:
            try:
                text = of["json"].decode()
                json.loads(text)
            except ValueError:
                text = "{}"
        elif "txt" in of:
            text = json.dumps({"txt": of["txt"].decode("utf-8", "ignore")}, ensure_ascii=False)
        yield key, picture, of[picture], text


class _File(InputPartition):
    def __init__(self, uri: str, first: int = 0, last: int = 0):
        self.uri, self.first, self.last = uri, first, last


class _Reader(DataSourceReader):
    """rows(uri, stream, whether it is a head only)."""

    def __init__(self, options: dict, suffixes: tuple[str, ...], rows):
        self.options, self.suffixes, self.rows = options, suffixes, rows

    def partitions(self):
        return [_File(u) for u in listed(self.options["path"], self.suffixes)]

    def read(self, partition):
        if partition is not None:
            head = self.options.get("headbytes")
            yield from self.rows(partition.uri, opened(partition.uri, int(head) if head else None), bool(head))


def _pair_rows(uri, stream, head):
    for row in (pictures if head else pairs)(members(stream, uri.endswith("gz"), head)):
        yield (uri, *row)


def _json_rows(uri, stream, head):
    for name, data in members(stream, uri.endswith("gz"), head):
        if name.endswith(".json"):
            try:
                json.loads(data)
            except ValueError:
                continue
            yield uri, name, data.decode()


class _ZipReader(DataSourceReader):
    """Members by their offsets: an archive's directory is read first, then ranges of members, so no archive is held whole."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        limit, out = int(self.options.get("rangebytes", ZIP_BYTES)), []
        for uri in listed(self.options["path"], (".zip",)):
            with zipfile.ZipFile(seekable(uri)) as z:
                first, size, n = 0, 0, 0
                for n, i in enumerate(z.infolist(), 1):
                    size += i.compress_size
                    if size >= limit:
                        out.append(_File(uri, first, n))
                        first, size = n, 0
                if n > first:
                    out.append(_File(uri, first, n))
        return out

    def read(self, partition):
        if partition is None:
            return
        with zipfile.ZipFile(seekable(partition.uri)) as z:
            for i in z.infolist()[partition.first : partition.last]:
                if not i.is_dir():
                    try:
                        yield partition.uri, i.filename, z.read(i), None
                    except (zipfile.BadZipFile, zlib.error) as e:  # the member; a fault of the store fails the task, which runs again
                        yield partition.uri, i.filename, None, str(e)


class TarPairs(DataSource):
    """Complete pairs of whole archives; with headBytes every picture of their heads. Options: path, headBytes."""

    @classmethod
    def name(cls):
        return "loomspan_tar_pairs"

    def schema(self):
        return "archive string, key string, kind string, picture binary, text string"

    def reader(self, schema):
        return _Reader(dict(self.options), (".tar", ".tar.gz", ".tgz"), _pair_rows)


class TarJson(DataSource):
    """SRC-09. Options: path, headBytes."""

    @classmethod
    def name(cls):
        return "loomspan_tar_json"

    def schema(self):
        return "archive string, name string, text string"

    def reader(self, schema):
        return _Reader(dict(self.options), (".tar", ".tar.gz", ".tgz"), _json_rows)


class ZipMembers(DataSource):
    """SRC-06. A damaged member is a row with its error. Options: path, rangeBytes."""

    @classmethod
    def name(cls):
        return "loomspan_zip"

    def schema(self):
        return "archive string, name string, data binary, error string"

    def reader(self, schema):
        return _ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (TarPairs, TarJson, ZipMembers):
        spark.dataSource.register(source)


def with_fallback(wanted: DataFrame, zipped: DataFrame, fetched: DataFrame, key: str = "name") -> DataFrame:
    """SRC-06: bytes from the zip, else from the fetch of what the zip lacks."""
    z = zipped.select(F.col("name").alias(key), F.col("data").alias("zip_data"))
    f = fetched.select(key, F.col("data").alias("url_data"))
    return wanted.join(z, key, "left").join(f, key, "left").withColumn("data", F.coalesce("zip_data", "url_data")).drop("zip_data", "url_data")
