"""Tar shards by member offsets: a sidecar of marks, range reads, a stream that resumes inside a shard (SRC-07, STM-01, STM-03, STM-04, STM-10).

`index` walks the headers of each shard once, seeking past the data, and leaves a mark about every `stride` bytes: shard, member
number, offsets. A mark is what one task reads, so a shard of any size is read by as many tasks as it has marks, and a reader never
touches what lies before its range. Shards in gzip can't be entered in the middle; they have one mark.

The stream's offset is (shard, member), the next member to read. A batch admits marks up to `bytesPerBatch` (one at least). What
has been admitted is kept in `progress`, since Spark tells a Python source no start; which members a batch holds rests
on Spark's own log of offsets alone, so a batch that runs again holds the same ones. Shards that come late are indexed behind the
others and are admitted next.

A shard that ends inside a member is an error with its name. Empty shards have no members; names and sizes have no limit but a worker's memory for one member.
"""

from __future__ import annotations

import bisect
import json
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .archives import _Info, listed, seekable
from .remote import filesystem

STRIDE, BATCH_BYTES, TAR_BYTES = 64 << 20, 1 << 30, 256 << 20
MARKS = "shard long, archive string, member long, begin long, end long, members long"
MEMBERS = "shard long, archive string, member long, name string, data binary"
_MARKS = pa.schema([("shard", pa.int64()), ("archive", pa.string()), ("member", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("members", pa.int64())])
_MEMBERS = pa.schema([("shard", pa.int64()), ("archive", pa.string()), ("member", pa.int64()), ("name", pa.string()), ("data", pa.binary())])
#: Bytes of members in an Arrow batch.
_BATCH = 8 << 20


def _walk(uri: str, begin: int, end: int | None):
    """(header offset, end of the data, file's TarInfo, its TarFile) of the members whose headers lie in [begin, end)."""
    source = seekable(uri)
    zipped = uri.endswith("gz")
    size = source.size()
    source.seek(begin)
    with tarfile.open(fileobj=source, mode="r|gz" if zipped else "r:", tarinfo=_Info) as tar:
        while (m := tar.next()) is not None and (zipped or end is None or m.offset < end):
            if not zipped and m.offset_data + m.size > size:
                raise EOFError(f"{uri}: ends inside {m.name}")
            if m.isfile():
                yield m, tar
            if not zipped:
                tar.members = []  # a walk remembers nothing


def _marks(uri: str, shard: int, stride: int):
    begin, number, first, last = 0, 0, 0, 0
    for m, _ in _walk(uri, 0, None):
        if not uri.endswith("gz") and m.offset - begin >= stride and number > first:
            yield (shard, uri, first, begin, m.offset, number - first)
            begin, first = m.offset, number
        number += 1
        last = m.offset_data + m.size
    if number > first:
        yield (shard, uri, first, begin, last, number - first)


def index(spark: SparkSession, path: str, where: str, stride: int = STRIDE) -> DataFrame:
    """The marks of the shards below path that `where` doesn't know yet, added to it behind the others; a shard is one task's walk."""
    known = marks(spark, where).agg(F.max("shard")).first()[0] if _there(where) else None
    seen = {r.archive for r in marks(spark, where).select("archive").distinct().collect()} if known is not None else set()
    new = [(s, u) for s, u in enumerate((u for u in listed(path, (".tar", ".tar.gz", ".tgz")) if u not in seen), 0 if known is None else known + 1)]
    rows = spark.createDataFrame(new, "shard long, archive string").repartition(max(1, len(new)), "shard")

    def walk(batches):
        for rb in batches:
            for shard, uri in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                found = list(_marks(uri, shard, stride))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_MARKS)], schema=_MARKS)

    rows.mapInArrow(walk, MARKS).write.mode("append").parquet(where)
    return marks(spark, where)


def _there(where: str) -> bool:
    from pyarrow.fs import FileType

    system, base = filesystem(where)
    return system.get_file_info(base).type != FileType.NotFound


def marks(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(MARKS).parquet(where)


def _read(shard: int, uri: str, member: int, begin: int, end: int):
    """Arrow batches of a mark's members."""
    rows, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEMBERS)], schema=_MEMBERS)
    for m, tar in _walk(uri, begin, end):
        data = tar.extractfile(m).read()
        if len(data) != m.size:
            raise EOFError(f"{uri}: ends inside {m.name}")
        rows.append((shard, uri, member, m.name, data))
        member += 1
        size += m.size
        if size >= _BATCH:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read(spark: SparkSession, where: str) -> DataFrame:
    """All members of the shards that `where` has marks of: a task a mark."""
    known = marks(spark, where)

    def run(batches):
        for rb in batches:
            for row in zip(*(rb.column(c).to_pylist() for c in ("shard", "archive", "member", "begin", "end")), strict=True):
                yield from _read(*row)

    return known.repartition(max(1, min(known.count(), 100_000)), "shard", "member").mapInArrow(run, MEMBERS)


class _Mark(InputPartition):
    def __init__(self, row: tuple):
        self.row = row


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.where, self.progress, self.limit = options["path"], options["progress"], int(options.get("bytesperbatch", BATCH_BYTES))

    def _known(self) -> list[tuple]:
        """(shard, member, archive, begin, end, members) of all marks in order: a row for every `stride` bytes of the shards."""
        import pyarrow.parquet as pq

        system, base = filesystem(self.where)
        t = pq.read_table(base, filesystem=system, schema=_MARKS) if _there(self.where) else pa.table([[]] * len(_MARKS), schema=_MARKS)
        return sorted(zip(*(t[c].to_pylist() for c in ("shard", "member", "archive", "begin", "end", "members")), strict=True))

    def _admitted(self, new: dict | None = None) -> dict:
        system, base = filesystem(self.progress)
        system.create_dir(base, recursive=True)
        if new is not None:
            draft = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write(json.dumps(new).encode())
            system.move(draft, f"{base}/admitted.json")
            return new
        if not _there(f"{self.progress}/admitted.json"):
            return self.initialOffset()
        with system.open_input_stream(f"{base}/admitted.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"shard": 0, "member": 0}

    def latestOffset(self) -> dict:
        known, at = self._known(), self._admitted()
        first = bisect.bisect_left(known, (at["shard"], at["member"]))
        size, k = 0, first
        while k < len(known) and (k == first or size < self.limit):
            size += known[k][4] - known[k][3]
            k += 1
        if k == first:
            return at
        shard, member, *_, members = known[k - 1]
        return self._admitted({"shard": shard, "member": member + members})

    def partitions(self, start: dict, end: dict):
        known = self._known()
        of = [m for m in known if (start["shard"], start["member"]) <= m[:2] < (end["shard"], end["member"])]
        return [_Mark((shard, uri, member, begin, stop)) for shard, member, uri, begin, stop, _ in of]

    def read(self, partition):
        yield from _read(*partition.row)


class TarStream(DataSource):
    """Options: path (folder of marks), progress (a folder of the query's own), bytesPerBatch."""

    @classmethod
    def name(cls):
        return "loomspan_tar_stream"

    def schema(self):
        return MEMBERS

    def streamReader(self, schema):
        return _Stream(dict(self.options))


def stream(spark: SparkSession, where: str, progress: str, bytes_per_batch: int = BATCH_BYTES) -> DataFrame:
    spark.dataSource.register(TarStream)
    return spark.readStream.format("loomspan_tar_stream").option("path", where).option("progress", progress).option("bytesPerBatch", bytes_per_batch).load()


def write(df: DataFrame, name: str, data: str, where: str, most: int = TAR_BYTES) -> None:
    """Rows as members of tar shards of about `most` bytes, some a task. Members are written as they come, so a task holds one, not a shard. A shard gets its name when it is whole; tasks that run again replace theirs."""
    rows = df.select(F.col(name).cast("string"), F.col(data).cast("binary"))

    def run(batches):
        import io

        from pyspark import TaskContext

        system, base = filesystem(where)
        system.create_dir(base, recursive=True)
        task, shard, size, held, n = TaskContext.get().partitionId(), None, 0, 0, 0

        def whole():
            """Closes the shard and gives it its name."""
            tar, sink = shard
            tar.close()
            sink.close()
            at = f"{base}/shard-{task:06d}-{n:04d}.tar"
            system.move(f"{at}.part", at)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held], pa.int64())], ["path", "n"])

        for rb in batches:
            for key, body in zip(rb.column(0), rb.column(1), strict=True):
                if shard is None:
                    sink = system.open_output_stream(f"{base}/shard-{task:06d}-{n:04d}.tar.part")
                    shard = tarfile.open(fileobj=sink, mode="w|"), sink
                info, body = tarfile.TarInfo(key.as_py() or ""), body.as_py() or b""
                info.size = len(body)
                shard[0].addfile(info, io.BytesIO(body))
                shard[0].members = []  # a TarFile keeps all headers
                size, held = size + len(body), held + 1
                if size >= most:
                    yield whole()
                    shard, size, held, n = None, 0, 0, n + 1
        if shard is not None:
            yield whole()

    rows.mapInArrow(run, "path string, n long").write.format("noop").mode("overwrite").save()


def drain(frame: DataFrame, where: str, checkpoint: str) -> None:
    """Runs a stream until it has taken all that is there; rows go to Parquet files once each."""
    query = frame.writeStream.format("parquet").option("path", where).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
