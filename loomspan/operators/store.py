"""A merged corpus on Parquet (SNK-01..07, C1..C8): staging by source and bucket, merge, late append, snapshots, check.

    root/staging/load=<id>/ingest_source=<s>/bucket=<b>/   rows as they come (SNK-01), a folder for each load
    root/rows/part=<id>/bucket=<b>/                        what a merge or a late append adds, with each row's place in its part
    root/log/<version>.json                                parts in order, rows of each bucket in each part, sources, statistics

The log is the truth: rows are written first, under a name of their own, and a version that names them last. Versions are
made by one writer each (the file is created only where it does not exist), so writers need no lock: one that loses a
version reads the newest and tries again. It checks what it has read: an append still holds after other sources' appends, since a
row's place in its bucket is its part's place plus what the log counts before that part, and no row is written again; an
append of a source that has come in meanwhile, or a merge after any commit, is refused (Conflict). A crash between rows and
log leaves what was valid before (C8); `vacuum` removes such rows later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.curate import channel_stats
from loomspan.operators.log import Conflict, Log
from loomspan.operators.sampling import ordinals, per_group

STATS_ROWS = 40_000
#: Sequence numbers whose places one task counts.
BLOCK = 1_000_000

class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)
        self.root = self.log.root

    def versions(self) -> list[int]:
        return self.log.versions()

    def manifest(self, version: int | None = None) -> dict | None:
        """The log's entry of a version, the newest by default; None where nothing is merged yet."""
        return self.log.entry(version)

    def stage(self, rows: DataFrame, source: str) -> None:
        """SNK-01: rows (seq, bucket, val, latent, ...) of an ingest source by bucket; loads of several writers don't touch each other."""
        rows.withColumn("ingest_source", F.lit(source)).write.partitionBy("ingest_source", "bucket").parquet(f"{self.root}/staging/load={uuid.uuid4().hex}x")

    def staged(self) -> DataFrame:
        """Rows of the loads that ended well."""
        names = [s.getPath().getName() for s in self.log.listed("staging")]
        loads = [f"{self.root}/staging/{n}" for n in names if self.log.files().exists(self.log.path(f"staging/{n}/_SUCCESS"))]
        return self.spark.read.option("basePath", f"{self.root}/staging").parquet(*loads).drop("load")

    def staged_rows(self, source: str) -> int:
        return self.staged().where(F.col("ingest_source") == source).count() if self.log.listed("staging") else 0

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default), with row_no, the place in the bucket."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"{self.root}: nothing merged")
        before, starts = {}, []
        for part in m["parts"]:
            for bucket, n in part["counts"].items():
                starts.append((part["name"], bucket, before.get(bucket, 0)))
                before[bucket] = before.get(bucket, 0) + n
        rows = self.spark.read.option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/part={p['name']}" for p in m["parts"]])
        # A row a part and bucket.
        first = self.spark.createDataFrame(starts, "_part string, _bucket string, _before long")
        placed = rows.join(F.broadcast(first), (F.col("part") == F.col("_part")) & (F.col("bucket").cast("string") == F.col("_bucket")))
        return placed.withColumn("row_no", F.col("_before") + F.col("at")).drop("_part", "_bucket", "_before", "at", "part")

    def _written(self, placed: DataFrame) -> tuple[dict, DataFrame]:
        """(the log's record of a new part, its rows)."""
        name = f"p{uuid.uuid4().hex}"
        placed.write.partitionBy("bucket").parquet(f"{self.root}/rows/part={name}")
        rows = self.spark.read.parquet(f"{self.root}/rows/part={name}")
        counts = {str(r.bucket): r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        return {"name": name, "counts": counts}, rows

    def merge(self, exclude: tuple[str, ...] = (), stats_rows: int = STATS_ROWS) -> dict:
        """SNK-04, SET-09: all staged sources but `exclude`, instead of what was merged before; position in a bucket goes by source, then by order in it (WIN-12)."""
        read = self.manifest()
        rows = self.staged().where(~F.col("ingest_source").isin(*exclude)) if exclude else self.staged()
        rows = rows.withColumn("_block", F.floor(F.col("seq") / BLOCK))
        keys = ["bucket", "ingest_source", "_block"]
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("ingest_source", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Offsets of blocks come from their counts, so neither a bucket's nor a source's rows are ever one window.
        placed = rows.join(sizes.withColumn("_before", before).drop("_n"), keys)
        placed = placed.withColumn("at", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1).drop("_before", "_block")
        part, merged = self._written(placed)
        sources = sorted(r.ingest_source for r in merged.select("ingest_source").distinct().collect())
        made = {"parts": [part], "merged": sources, **self._stats(merged, stats_rows)}

        def change(now: dict | None) -> dict:
            if (now or {}).get("version") != (read or {}).get("version"):
                raise Conflict(f"version {now['version']} was committed while this merge ran; merge again")
            return made

        return self.log.commit(change)

    def _stats(self, rows: DataFrame, stats_rows: int) -> dict:
        """AGG-04, AGG-05: whitening statistics of a hash sample, one row of each bucket and source at least."""
        sizes = rows.groupBy("bucket", "ingest_source").agg(F.count("*").alias("_n"))
        per_bucket = Window.partitionBy("bucket")
        k = F.least("_n", F.greatest(F.lit(1), F.floor(F.lit(stats_rows) * F.col("_n") / F.greatest(F.lit(1), F.sum("_n").over(per_bucket) * 5)))).cast("int")
        sample = per_group(rows.join(F.broadcast(sizes.withColumn("_k", k).drop("_n")), ["bucket", "ingest_source"]), ["bucket", "ingest_source"], "stats", "id", F.col("_k"), stats_rows)
        s = channel_stats(sample, "latent").orderBy("channel").collect()
        return {"mean": [r.mean for r in s], "std": [r.std for r in s]}

    def append(self, source: str, force: bool = False) -> dict:
        """SNK-05: a staged source after the merge. Old rows, their places and the statistics stay; a known source is refused unless forced."""

        def known(m: dict | None) -> dict:
            if m is None:
                raise FileNotFoundError("merge first")
            if source in m["merged"] and not force:
                raise Conflict(f"{source} is merged already (version {m['version']})")
            return m

        known(self.manifest())
        new = ordinals(self.staged().where(F.col("ingest_source") == source), ["bucket"], [], "seq", "at").withColumn("at", F.col("at") - 1)
        part, _ = self._written(new)

        def change(now: dict | None) -> dict:
            m = known(now)
            return m | {"parts": [*m["parts"], part], "merged": [*m["merged"], source]}

        return self.log.commit(change)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Removes parts that none of the last `keep` versions name and that are older than `hours`, so that no writer at work loses its rows; returns them.

        Older versions can no longer be read afterwards.
        """
        named = {f"part={p['name']}" for v in self.versions()[-keep:] for p in self.manifest(v)["parts"]}
        return [n.removeprefix("part=") for n in self.log.vacuum("rows", named, hours)]

    def check(self) -> DataFrame:
        """AGG-03, AGG-07, C1: rows, hold-out rows, mean crop and gaps in the places of each bucket."""
        d = self.rows().groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("val").alias("n_val"), F.avg("crop").alias("crop"), F.min("row_no").alias("_lo"), F.max("row_no").alias("_hi"), F.countDistinct("row_no").alias("_d"))
        return d.withColumn("whole", (F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n"))).drop("_lo", "_hi", "_d")

    def progress(self, source: str, stats: dict[str, int]) -> None:
        """SNK-02, SNK-11, STM-06: counters of a finished unit, appended to a ledger."""
        row = [(source, {k: int(v) for k, v in stats.items()})]
        self.spark.createDataFrame(row, "ingest_source string, stats map<string,long>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def totals(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.root}/ledger").select("ingest_source", F.explode("stats").alias("name", "n"))
        return d.groupBy("ingest_source", "name").agg(F.sum("n").alias("n"))


def log_row(df: DataFrame, path: str) -> None:
    """SNK-03: metric rows appended as JSON."""
    df.coalesce(1).write.mode("append").json(path)


def cover_box(w: Column, h: Column, bw: int, bh: int) -> Column:
    """PRJ-09: resized size and crop corner that cover a bucket; half-even rounding, floor division."""
    s = F.greatest(F.lit(float(bw)) / w, F.lit(float(bh)) / h)
    nw, nh = F.greatest(F.lit(bw), F.bround(w * s, 0).cast("int")), F.greatest(F.lit(bh), F.bround(h * s, 0).cast("int"))
    return F.struct(nw.alias("w"), nh.alias("h"), F.floor((nw - bw) / 2).cast("int").alias("left"), F.floor((nh - bh) / 2).cast("int").alias("top"))
