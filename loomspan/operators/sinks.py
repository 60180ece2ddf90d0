"""Sinks beside Spark's own: numpy files (SNK-10), HTML contact sheets (SNK-12)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as S
from loomspan.operators.sampling import chunks
from loomspan.sources.remote import filesystem

#: Rows of one numpy file: what a task holds.
FILE_ROWS = 65_536


def write_numpy(df: DataFrame, column: str, where: str, kind: str = "npy", name: str = "values", rows: int = FILE_ROWS) -> DataFrame:
    """Vectors of one length as .npy or .npz files, some a task; returns path, first, n_rows, written as the files are.

    A task that runs again writes other names; only names in the result count. Null vectors are an error.
    """

    def run(batches):
        from pyspark import TaskContext

        system, base = filesystem(where)
        system.create_dir(base, recursive=True)
        task, held, n, first, files = TaskContext.get(), [], 0, 0, 0

        def put():
            x = np.concatenate(held)
            out = io.BytesIO()
            np.save(out, x) if kind == "npy" else np.savez(out, **{name: x})
            path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:05d}.{kind}"
            with system.open_output_stream(f"{base}/{path}", compression=None) as sink:
                sink.write(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([len(x)], pa.int64())], ["path", "first", "n_rows"])

        for rb in batches:
            while rb.num_rows:
                part, rb = rb.slice(0, rows - n), rb.slice(rows - n)
                if part.column(0).null_count:
                    raise ValueError("null vector")
                held.append(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                n += part.num_rows
                if n == rows:
                    yield put()
                    first, files, held, n = first + n, files + 1, [], 0
        if held:
            yield put()

    return df.select(column).mapInArrow(run, "path string, first long, n_rows long")


def contact_sheets(df: DataFrame, by: list[str], order: str, picture: Column | None, caption: Column, per_page: int = 48) -> DataFrame:
    """SNK-12: by..., page, html: a page of cells for each `per_page` rows of a group, in order.

    Pictures are embedded as data URLs; captions are escaped. A page is bounded by its cells, so a large group is many pages.
    """
    escaped = F.coalesce(caption, F.lit(""))
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(f"&{name};"))
    image = F.lit("") if picture is None else F.when(picture.isNotNull(), F.concat(F.lit('<img src="'), S.data_url(picture, "image/png"), F.lit('">'))).otherwise(F.lit(""))
    cells = chunks(df.withColumn("_cell", F.concat(F.lit("<figure>"), image, F.lit("<figcaption>"), escaped, F.lit("</figcaption></figure>"))), by, order, per_page)
    pages = cells.groupBy(*by, F.col("chunk").alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_cell")))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["_cell"]), "")
    return pages.select(*by, "page", F.concat(F.lit('<!doctype html><meta charset="utf-8">'), body).alias("html"))
