"""Plain file sources (SRC-01..05, SRC-10, SRC-12, SRC-17..19) and Parquet peeks."""

from __future__ import annotations

import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .archives import listed, opened
from .remote import filesystem


def projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC-01, SRC-02: only these columns are read; splits bound memory by spark.sql.files.maxPartitionBytes."""
    return spark.read.parquet(path).select(*columns)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-12: JSON lines with a stated schema; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_head(spark: SparkSession, path: str, schema: str, head_bytes: int) -> DataFrame:
    """SRC-10: rows of a file's first bytes. The last line may be cut off, so it never counts; bad lines are left out."""
    data = opened(path if "://" in path else "file://" + os.path.abspath(path), head_bytes).read()
    lines = [x for x in data.decode(errors="replace").split("\n")[:-1] if x.strip()]
    text = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line long, value string")
    parsed = text.select("line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$").isNotNull().alias("ok"))
    return parsed.where("ok").select("line", "r.*")


def nested_json(spark: SparkSession, path: str, images: str = "images", annotations: str = "annotations") -> tuple[DataFrame, DataFrame]:
    """SRC-05: (images, annotations) of one nested document, each exploded."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.inline(images)), d.select(F.inline(annotations))


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def run_logs(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """SRC-19: many files, keyed by their names without extension."""
    d = spark.read.schema(schema).json(pattern)
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    return d.withColumn("run", F.regexp_replace(name, r"\.[^.]*$", ""))


def parquet_peek(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: file, bytes, rows and row groups from footers alone, read where the files are listed."""

    def footer(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for rb in batches:
            rows = []
            for uri in rb.column(0).to_pylist():
                system, base = filesystem(uri)
                m = pq.read_metadata(base, filesystem=system)
                rows.append((uri, system.get_file_info(base).size, m.num_rows, m.num_row_groups, m.num_columns))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(5)], ["file", "bytes", "n_rows", "row_groups", "columns"])

    files = spark.createDataFrame([(u,) for u in listed(path, (".parquet",))], "file string")
    return files.mapInArrow(footer, "file string, bytes long, n_rows long, row_groups long, columns long")


class _Group(InputPartition):
    def __init__(self, uri: str, group: int):
        self.uri, self.group = uri, group


class _GroupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        """One row group of each file, by seed; only footers are read here."""
        import random

        import pyarrow.parquet as pq
        out = []
        for uri in listed(self.options["path"], (".parquet",)):
            system, base = filesystem(uri)
            n = pq.read_metadata(base, filesystem=system).num_row_groups
            if n:
                out.append(_Group(uri, random.Random(f"{self.options.get('seed', '0')}/{os.path.basename(uri)}").randrange(n)))
        return out

    def read(self, partition):
        if partition is not None:
            import json

            import pyarrow.parquet as pq

            system, base = filesystem(partition.uri)
            columns = self.options.get("columns")
            with system.open_input_file(base) as f:
                t = pq.ParquetFile(f).read_row_group(partition.group, columns.split(",") if columns else None)
            for row in t.to_pylist():
                yield partition.uri, partition.group, json.dumps(row, default=str)


class RowGroupSample(DataSource):
    """SRC-04: rows of one random row group a file, as JSON. Options: path, seed, columns."""

    @classmethod
    def name(cls):
        return "loomspan_row_group"

    def schema(self):
        return "file string, row_group int, row string"

    def reader(self, schema):
        return _GroupReader(dict(self.options))


def numpy_arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """SRC-16, SRC-17: named arrays of .npz files (or the one of a .npy file) as rows of doubles: file, name, row, values."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            for file, data in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                held = np.load(io.BytesIO(data), allow_pickle=False)
                for name in names if file.endswith(".npz") else ["array"]:
                    a = held[name] if file.endswith(".npz") else held
                    rows = a.reshape(len(a), -1).astype(float) if a.ndim else a.reshape(1, 1).astype(float)
                    for at in range(0, len(rows), 1024):
                        part = rows[at : at + 1024]
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["file", "name", "row", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, name string, row long, values array<double>")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowGroupSample)
