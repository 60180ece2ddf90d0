"""Media columns: a data source over directories of archives.

Writing stores each payload losslessly as an 8-bit grey PNG of 576 samples a row, as a stored member of zip
archives. Reading plans byte ranges over the archives; a partition streams the members whose header lies in its
range through Arrow, and reads each member by its own offset, again and on its own when a read fails.

A null text is an empty one, and an empty payload is one row of padding. Repeated rows and equal doc_ids are
members of their own; a null doc_id comes back null. A second write to a folder adds to the first. A very long text is one member; batches are cut by bytes.
An empty table writes no archive and reads as no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 576
PAD = 255
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
#: A batch's texts have so many times the stored bytes at most; a guard for very repetitive texts.
BATCH_ROWS = 1024
RETRIES = 4
SCHEMA = "doc_id long, media binary"
#: Folder of manifests: one for each committed write, so that writes add up.
MANIFESTS = "_manifests"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def to_png(payload: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row, without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png made; every chunk's checksum is checked."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


class Range(InputPartition):
    """Members of one archive whose header starts in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Written(WriterCommitMessage):
    def __init__(self, archives: list):
        self.archives = archives


def read_member(where: str, path: str, info: zipfile.ZipInfo, source=None) -> bytes:
    """A stored member by its offset. Each attempt after the first opens the archive anew."""
    failure: Exception | None = None
    for attempt in range(RETRIES):
        try:
            if source is None or attempt:
                fs, base = common.filesystem(where)
                source = fs.open_input_file(f"{base}/{path}")
            head = source.read_at(30, info.header_offset)
            names, extra = struct.unpack("<HH", head[26:30])
            data = source.read_at(info.file_size, info.header_offset + 30 + names + extra)
            if head[:4] != b"PK\x03\x04" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"damaged member at {info.header_offset}")
            return data
        except (OSError, struct.error) as e:
            failure = e
            time.sleep(0.1 * 2**attempt if attempt < RETRIES - 1 else 0)
    raise OSError(f"{path}, offset {info.header_offset}: {failure}") from failure


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        """Byte ranges over the committed archives; only names and sizes come to the planner."""
        from pyarrow.fs import FileSelector

        fs, base = common.filesystem(self.where)
        archives = []
        for found in sorted(fs.get_file_info(FileSelector(f"{base}/{MANIFESTS}")), key=lambda x: x.path):
            with fs.open_input_stream(found.path) as f:
                archives += json.loads(f.read())
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)]

    def read(self, partition: Range | None):
        if partition is None:  # no archive
            return
        fs, base = common.filesystem(self.where)
        source = fs.open_input_file(f"{base}/{partition.path}")
        with zipfile.ZipFile(source) as z:
            members = sorted((m for m in z.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
            ids, media, size = [], [], 0
            for m in members:
                key = m.filename.split("-", 1)[1].removesuffix(".png")
                ids.append(None if key == "null" else int(key))
                media.append(read_member(self.where, partition.path, m, source))
                size += m.file_size
                if size >= BATCH_BYTES or len(ids) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])
                    ids, media, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.where, self.limit, self.job = options["path"], int(options.get("archivebytes", ARCHIVE_BYTES)), uuid.uuid4().hex

    def write(self, iterator):
        """Archives of one task, named by its write and attempt: only the attempt that commits gets into the write's manifest."""
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = common.filesystem(self.where)
        fs.create_dir(base, recursive=True)
        done, archive, sink, n = [], None, None, 0

        def close():
            nonlocal archive, sink
            if archive is not None:
                archive.close()
                done.append([name, sink.tell()])
                sink.close()
            archive = sink = None

        for rb in iterator:
            for key, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                if archive is None:
                    name = f"part-{self.job}-{task.partitionId():07d}-{task.taskAttemptId()}-{len(done):04d}.zip"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n}-{'null' if key is None else key}.png"), to_png(padded((text.as_py() or "").encode())))
                n += 1
                if sink.tell() >= self.limit:
                    close()
        close()
        return Written(done)

    def commit(self, messages):
        fs, base = common.filesystem(self.where)
        fs.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFESTS}/{self.job}.json") as f:
            f.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages):
        """Uncommitted archives are in no manifest and are never read."""


class MediaArchives(DataSource):
    """Options: path (folder URI), rangebytes, archivebytes."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def store(docs: DataFrame, where: str) -> None:
    docs.sparkSession.dataSource.register(MediaArchives)
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).write.format("loomspan_media").option("path", where).mode("append").save()


def load(spark: SparkSession, where: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("loomspan_media").option("path", where).load()


def features(media: DataFrame) -> DataFrame:
    """Payload and form figures of each stored member, from the bytes that were read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for rb in batches:
            rows = []
            for form in rb.column(1):
                form = form.as_py()
                payload = from_png(form)
                x = np.frombuffer(payload, np.uint8)
                n = len(payload.rstrip(bytes([PAD])))
                counts = np.bincount(x, minlength=256)
                edges = int(np.abs(np.diff(x.astype(np.int16))).astype(np.int64).sum())
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), f"rows={len(x) // WIDTH};sum={int((counts * np.arange(256)).sum())};square={int((counts * np.arange(256) ** 2).sum())};mode={int(counts.argmax())};levels={int((counts > 0).sum())};edges={edges}"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rb.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = common.shared_dir(spark)
    store(common.table(spark, sf_dir, "documents"), where)
    return features(load(spark, where))
