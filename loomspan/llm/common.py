"""What the training-data operators share: inputs, the shared folder, Arrow helpers.

Conventions of all operators here: a null text is an empty text; rows are never dropped or merged
because they repeat; extra input columns are ignored unless an operator says that it carries them.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from loomspan.session import shared_base

#: White space that separates words: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of documents that one part of a table beside them says something about.
LOOKUP_ROWS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name (not created) under the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Only where it is unset, and the master local (tests), an own one is set.
    """
    return f"{shared_base(spark)}/loomspan-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; works on the driver and on executors."""
    from loomspan.sources.remote import filesystem as opened

    return opened(uri)


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, after a large step has been written.

    Spark drops them when the driver's garbage is collected, and a driver with little to do may not collect any for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """left with the columns of right (a row per key), by a merge join; keys without a row in right give nulls.

    A key that holds a thousandth of left's rows (and `least` at least) is joined by broadcast instead, so that no task
    gets all its rows: there are 1,000 such keys at most.
    """
    least = max(least, left.count() // 1000)
    heavy = written(left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys, F.lit(True).alias("_hot")))
    if heavy.isEmpty():
        return left.join(right.hint("merge"), keys, "left")
    marked = left.join(F.broadcast(heavy), keys, "left")
    hot = marked.where("_hot").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, "left")
    return hot.unionByName(marked.where("_hot is null").join(right.hint("merge"), keys, "left")).drop("_hot")


def dealt(rows: DataFrame, by: str, most: int = 20_000) -> DataFrame:
    """rows with their `number` in order of `by`, one row a task, or several where there are more than `most`.

    For small tables of work items (a row per file): Spark would gather their few bytes in one task.
    """
    numbered = written(rows.withColumn("number", F.row_number().over(Window.orderBy(by)) - 1))
    tasks = max(1, min(numbered.count(), most))
    return numbered.repartitionById(tasks, F.pmod(F.col("number"), F.lit(tasks)).cast("int"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that a plan reads (file sizes at its leaves)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, whatever its projection; falls back to the plan's estimate."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, text: of the rows with equal keys, the text with the smallest hash. A task sends on a row a key, so a key with many rows is no one's burden."""
    return rows.groupBy(*keys).agg(F.min_by(F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).alias("text"))


def sampled(docs: DataFrame, bound: int) -> DataFrame:
    """_id, text: one row for each of at most `bound` ids, those whose hashes are smallest; rows without id are left out."""
    ids = docs.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(bound)
    return one_each(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")), "_id")


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs with `_file` and `_row`, which tell rows apart whatever they hold: a hash of the file's name, and the place in it.

    Rows that come from no file are written to one first; rows that have a key keep it.
    """
    if {"_file", "_row"} <= set(docs.columns):
        return docs
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return written(docs).select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def beside_rows(docs: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """The rows of docs that small names (`_file` and `_row` of `row_keyed`, each once), with small's other columns; n: docs' rows.

    Rows of docs stay in the tasks that read them, so texts are not shuffled: small is written in parts of LOOKUP_ROWS rows of docs, by
    file and place, and a task reads the parts that its own rows are in.
    """
    parts = max(1, -(-n // LOOKUP_ROWS))
    part = F.pmod(F.xxhash64("_file", F.floor(F.col("_row") / F.lit(LOOKUP_ROWS))), F.lit(parts)).cast("int")
    where = shared_dir(docs.sparkSession)
    small.withColumn("_part", part).repartition(parts, "_part").write.partitionBy("_part").parquet(where)
    names, more = [c for c in docs.columns if c not in ("_file", "_row")], [c for c in small.columns if c not in ("_file", "_row")]

    def read(part):
        """By file: the sorted places of small's rows in this part, and those rows."""
        fs, path = filesystem(f"{where}/_part={part}")
        if fs.get_file_info(path).type != pa.fs.FileType.Directory:
            return {}
        table = pq.read_table(path, filesystem=fs, partitioning=None).combine_chunks()
        files, found = table["_file"].to_numpy(), {}
        for f in np.unique(files).tolist():
            rows = table.filter(pa.array(files == f)).sort_by("_row")
            found[f] = rows["_row"].to_numpy(), rows.select(more)
        return found

    fields = [(c, small.schema[c].dataType) for c in more]
    said = StructType([StructField("_here", BooleanType()), *[StructField(c, t) for c, t in fields]])
    types = to_arrow_schema(said)

    def look(batches):
        held: dict = {}
        for columns in batches:
            files, rows, of = (c.to_numpy() for c in columns)
            tables, at, beside = [types.empty_table()], np.full(len(of), -1), 0
            for p in np.unique(of).tolist():
                if p not in held:
                    if len(held) >= 4:
                        held.clear()
                    held[p] = read(p)
                for f in np.unique(files[of == p]).tolist():
                    if f not in held[p]:
                        continue
                    places, table = held[p][f]
                    mine = np.flatnonzero((of == p) & (files == f))
                    to = np.minimum(np.searchsorted(places, rows[mine]), len(places) - 1)
                    hit = places[to] == rows[mine]
                    at[mine[hit]] = beside + np.arange(hit.sum())
                    beside += int(hit.sum())
                    taken = [c.take(pa.array(to[hit])) for c in table.columns]
                    tables.append(pa.table([pa.array(np.ones(hit.sum(), bool)), *taken], names=types.names).cast(types))
            found = pa.concat_tables(tables).take(pa.array(at, mask=at < 0))
            yield pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.nulls(0, c.type) for c in found.columns], names=types.names)

    # Only keys go to Python; it is asked once a row, since what might change is neither repeated nor pushed down.
    asked = arrow_udf(look, said, ArrowUDFType.SCALAR_ITER).asNondeterministic()
    keyed = docs.select(*names, "_file", "_row", part.alias("_part")).withColumn("_said", asked("_file", "_row", "_part"))
    return keyed.where("_said._here").select(*names, *[F.col(f"_said.{c}").alias(c) for c in more])


def parts_for(df: DataFrame, mb: float) -> int:
    """Partitions so that each holds about that many MB of the files below the plan; one wave of cores at least.

    Where Spark knows no size (rows of the driver, other sources), spark.sql.shuffle.partitions stands in.
    """
    spark = df.sparkSession
    size, most = scan_bytes(df), 1 << 55
    known = -(-size // int(mb * 1e6)) if size < most else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, known)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying each text; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)


def release() -> None:
    """Gives a worker's freed memory back: workers outlive their task, and others of their executor need room."""
    import ctypes

    from . import shingles

    shingles._powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
