"""WARC archives: written as whole-file gzip streams, normalised to a member per record, read by offset.

Of records with equal payloads that with the smallest page_id is the response, the others revisit it.

The normaliser inflates each monolithic file once, as a stream, rewrites every record as a gzip member of its
own and writes a sidecar of offsets beside it. A lost task writes its file again under another name; only
names that a finished task returned are read on.

A null html is an empty payload; rows with the smallest page_id and the same payload are all responses; rows
with a null page_id revisit the smallest one of their payload, or are responses where all are null. A null url leaves the
header out. A very long html is one record, held by one task. An empty table writes no file and gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Raw bytes of a monolithic file: what one task inflates.
FILE_BYTES = 128 << 20
CHUNK = 1 << 20
#: Records that a reader takes from a file at a time, and tasks that work on files at most: beyond, a task has several.
READ_RECORDS = 16_384
TASKS = 20_000
LEVEL = 1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_types(pages: DataFrame) -> DataFrame:
    """pages with `digest` (hex SHA-1 of the payload) and `refers_to`, null for responses.

    Only keys and digests are compared; the payloads themselves are shuffled once at most, by page, and
    not at all where no payload repeats.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = common.written(p.select("page_id", "digest"))
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # A page that very many others equal is a hot digest.
    again = common.hot_join(keys, firsts, ["digest"]).where("first is not null and (page_id is null or page_id <> first)")
    again = common.written(again.select(F.col("page_id").alias("page"), F.col("digest").alias("d"), "first").distinct())
    joined = p.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def records(chunks) -> "iter":
    """Whole records out of a stream of inflated chunks; holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            size = int(fields(bytes(held[at:end]))["Content-Length"])
            stop = end + 4 + size + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise EOFError("truncated record")


def inflated(file):
    """Chunks of a gzip stream, whatever number of members it has."""
    stream = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            yield stream.decompress(data)
            data = stream.unused_data
            if stream.eof and data:
                stream = zlib.decompressobj(31)
    if not stream.eof:
        raise EOFError("truncated gzip stream")


def _task() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():07d}-{t.taskAttemptId()}"


def write_monolithic(typed: DataFrame, where: str) -> DataFrame:
    """Whole-file gzip archives; returns a row per file (path)."""

    def write(batches):
        fs, base = common.filesystem(where)
        fs.create_dir(base, recursive=True)
        sink, names, size = None, [], 0
        for rb in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                if sink is None:
                    names.append(f"raw-{_task()}-{len(names):04d}.warc.gz")
                    sink, size, packer = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                sink.write(packer.compress(data))
                size += len(data)
                if size >= FILE_BYTES:
                    sink.write(packer.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.write(packer.flush())
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return typed.mapInArrow(write, "path string")


def normalise(files: DataFrame, where: str) -> DataFrame:
    """Every monolithic file rewritten with a member per record, and its sidecar `<file>.idx` of offsets.

    Returns a row per file: path, n_records.
    """

    def run(batches):
        fs, base = common.filesystem(where)
        for rb in batches:
            for k, name in enumerate(rb.column(0).to_pylist()):
                out = f"norm-{_task()}-{k:04d}-{name.removeprefix('raw-')}"
                at, index = 0, []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source, fs.open_output_stream(f"{base}/{out}", compression=None) as sink:
                    for data in records(inflated(source)):
                        member = gzip.compress(data, LEVEL, mtime=0)
                        sink.write(member)
                        index.append(f"{at} {len(member)}\n")
                        at += len(member)
                with fs.open_output_stream(f"{base}/{out}.idx", compression=None) as sink:
                    sink.write("".join(index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([len(index)], pa.int64())], ["path", "n_records"])

    return files.mapInArrow(run, "path string, n_records long")


def read(files: DataFrame, where: str) -> DataFrame:
    """A row per record, each read by its offset from the sidecar, its payload checked against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    slices = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_records") - 1, F.lit(0)), F.lit(READ_RECORDS).cast("long"))))
    slices = slices.select("path", "first", F.format_string("%s/%012d", "path", "first").alias("place"))

    def key(urn: str) -> int | None:
        name = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if name == "null" else int(name)

    def run(batches):
        fs, base = common.filesystem(where)
        for rb in batches:
            for name, first in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()[first : first + READ_RECORDS]]
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for at, size in index:
                        data = gzip.decompress(f.read_at(size, at))
                        end = data.index(b"\r\n\r\n")
                        h = fields(data[:end])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = data[end + 4 + len(HTTP) : -4]
                            digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                            if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                                raise ValueError(f"{name}, offset {at}: payload and digest differ")
                        refers = h.get("WARC-Refers-To")
                        rows.append((key(h["WARC-Record-ID"]), n, digest, h["WARC-Type"], refers and key(refers)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return common.dealt(slices, "place", TASKS).select("path", "first").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = common.shared_dir(spark)
    raw = common.written(write_monolithic(with_types(common.table(spark, sf_dir, "pages")), where))
    return read(common.written(normalise(common.dealt(raw, "path", TASKS).select("path"), where)), where)


#: Base32 of a SHA-1: each 5 hex digits are 4 symbols of 5 bits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT p.page_id, p.n::bigint AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(p.h, ((i // 4) * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f USING (h)
"""
