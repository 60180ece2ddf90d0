"""Token-id output: documents in ascending id order as Simple-8b files, read back with global offsets.

A file is what one range of ids gives; the manifest is a table with a row per file, and readers get whole files, dealt
evenly by their number. Neither files nor rows of the manifest come to the driver.

Null texts are empty and get the end id alone. Rows with a null doc_id stand first; rows with equal doc_id
stand in one file, keep one order there and share no ids. Very long texts are framed by their own. An empty table
writes no file and returns no row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, simple8b
from .tokenize import default_path, ids_of

#: Ids in a frame: what a reader holds at once; packing takes some hundred bytes an id meanwhile.
FRAME_IDS = 1 << 18
#: MB of the input's files in one token file.
FILE_MB = 64
#: Tasks that read at most: beyond so many files each task reads several.
READ_TASKS = 20_000
MANIFEST = "part int, path string, n_docs long, n_ids long"
ROWS = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])


def write_files(docs: DataFrame, where: str, vocabulary: str, kind: str, end_id: int, file_mb: float = FILE_MB) -> DataFrame:
    """Writes one file per range of ids and returns the manifest: a row per file, numbered in id order."""
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():07d}-{task.taskAttemptId()}.s8b"
        coder, n_docs, n_ids, sink = ids_of(vocabulary, kind), 0, 0, None
        end = np.array([end_id], "<u4").tobytes()
        held, size = [], 0

        def flush():
            nonlocal held, size, sink
            if held:
                if sink is None:
                    fs, path = common.filesystem(where)
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}")
                keys = np.array([k or 0 for k, _ in held], np.int64)
                sink.write(simple8b.frame(keys, np.array([k is None for k, _ in held]), np.array([len(b) // 4 for _, b in held], np.int64), np.frombuffer(b"".join([b for _, b in held]), "<u4")))
            held, size = [], 0

        for rb in batches:
            for at in range(0, rb.num_rows, 2048):
                part = rb.slice(at, 2048)
                for key, ids in zip(part.column(0).to_pylist(), coder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    held.append((key, ids + end))
                    size += len(ids) // 4 + 1
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
                    if size >= FRAME_IDS:
                        flush()
        flush()
        if sink is not None:
            sink.close()
        common.release()
        if sink is not None:
            yield common.batch({"part": [task.partitionId()], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, schema)

    parts = common.parts_for(docs, file_mb)
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return common.written(ranged.mapInArrow(write, MANIFEST))


def planned(manifest: DataFrame) -> DataFrame:
    """part, path, base (ids in the files before) and number of each file, in partitions of whole files."""
    # A window over the manifest alone: a row per file.
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    return common.dealt(manifest.select("part", "path", before.alias("base")), "part", READ_TASKS)


def read_files(spark: SparkSession, where: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""

    def read(batches):
        for rb in batches:
            for name, base in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                fs, path = common.filesystem(where)
                at = base
                with fs.open_input_stream(f"{path}/{name}") as file:
                    for keys, nulls, counts, ids in simple8b.frames(file):
                        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=nulls), pa.array(at + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])
        common.release()

    return planned(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = common.shared_dir(spark)
    manifest = write_files(common.table(spark, sf_dir, "documents"), where, default_path("byte_bpe_50k.json"), "byte_bpe", 0)
    return read_files(spark, where, manifest)
