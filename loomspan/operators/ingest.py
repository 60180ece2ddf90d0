"""Ingest of captioned pictures into a Store (CLI-01, UDF-06, SRC-20, PRJ-01, PRJ-06): decode, bucket, encode, stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import images
from loomspan.operators import curate as C
from loomspan.operators import orderstat as O
from loomspan.operators.sampling import ordinals
from loomspan.operators.store import Store
from loomspan.operators.tables import spread

#: Pictures that an encoder gets at once.
BATCH = 64
ENCODED = "seq long, id string, bucket string, crop double, w int, h int, long array<string>, short array<string>, latent array<float>"


def mean_grid(pictures: list[np.ndarray], n: int = 4) -> list[np.ndarray]:
    """The encoder without a model: mean colours of n x n cells, from -1 to 1."""
    out = []
    for x in pictures:
        h, w, _ = x.shape
        ends = np.append(np.arange(n) * h // n, h)
        # Lines of bytes add up exactly as integers, and n lines are left to be cut.
        rows = np.stack([x[a : max(b, a + 1)].reshape(-1, w * 3).sum(axis=0, dtype=np.uint32) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        cells = np.add.reduceat(rows.reshape(n, w, 3).astype(float), np.arange(n) * w // n, axis=1)
        area = np.diff(np.append(np.arange(n) * h // n, h))[:, None] * np.diff(np.append(np.arange(n) * w // n, w))[None, :]
        out.append((cells / area[:, :, None] / 127.5 - 1).ravel())
    return out


def encoded(rows: DataFrame, encode: Callable[[list[np.ndarray]], list[np.ndarray]], batch: int = BATCH) -> DataFrame:
    """rows (seq, id, bucket, crop, w, h, long, short, rgb) with `latent`, `batch` pictures of one bucket at a time.

    A task holds fewer than `batch` pictures of each bucket, cut to the bucket's size, besides its Arrow batch.
    """
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {b: [] for b in C.BUCKETS}

        def put(bucket: str) -> pd.DataFrame:
            rows, held[bucket] = held[bucket], []
            vectors = encode([x for _, x in rows])
            return pd.DataFrame([(*r, np.asarray(v, np.float32)) for (r, _), v in zip(rows, vectors, strict=True)], columns=names)

        for f in frames:
            for r in f.itertuples(index=False):
                width, height = C.BUCKETS[r.bucket]
                pixels = images.cover(np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3), width, height)
                held[r.bucket].append(((r.seq, r.id, r.bucket, r.crop, r.w, r.h, r.long, r.short), pixels))
                if len(held[r.bucket]) == batch:
                    yield put(r.bucket)
        for b in held:
            if held[b]:
                yield put(b)

    return rows.mapInPandas(run, ENCODED)


def pictures(rows: DataFrame, store: Store, source: str, encode=mean_grid, real: bool = True, batch: int = BATCH, limit: int = 0, picture: Column | None = None, target: int = 0) -> dict[str, int]:
    """Stages rows (id, picture, long, short) as an ingest source and returns its counters, which the store's ledger gets too.

    failed: not decoded; dropped: out of the aspect range; no_caption: both caption lists empty. Each row counts once, in this order.
    The first HOLD_OUT rows of the source, by hash of their id, are its hold-out. `limit` is a smoke test's.
    `target` is how many rows the source is to have in all (SRT-05): what earlier runs have staged counts, rows beyond it, by the same
    hash, are not encoded and count as `beyond`; a source that has enough gets none. Without it there is no bound.
    """
    rows = rows.limit(limit) if limit else rows
    d = rows.select(F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 12).alias("seq"), F.col("id").cast("string").alias("id"), "long", "short", images.rgb_of(F.col("picture") if picture is None else picture).alias("p"))
    aspect = F.col("p.width") / F.col("p.height")
    d = d.withColumn("caps", C.assemble(F.col("long"), F.col("short"))).withColumn("at", C.bucket(aspect, real, F.col("id")))
    state = F.when(F.col("p.rgb").isNull(), "failed").when(F.col("at").isNull(), "dropped").when(F.col("caps").isNull(), "no_caption").otherwise("ok")
    # Written once: pixels are decoded once.
    where = f"{store.root}/drafts/ingest_source={source}"
    d.select("seq", "id", state.alias("state"), "at.bucket", "at.crop", F.col("p.width").alias("w"), F.col("p.height").alias("h"), "caps.long", "caps.short", F.col("p.rgb").alias("rgb")).write.mode("overwrite").parquet(where)
    drafts = store.spark.read.parquet(where)
    fine, n = drafts.where("state = 'ok'").drop("state"), drafts.where("state = 'ok'").count()
    before = store.staged_rows(source)
    need = n if not target else min(n, max(0, target - before))
    if need < n:
        # The hash that the last wanted row has; hashes have 52 bits, which doubles hold.
        last = O.at_ranks(fine.select("seq"), [], "seq", F.array(F.lit(max(0, need - 1)).cast("long"))).first()["value"]
        fine = fine.where(F.col("seq") <= last) if need else fine.limit(0)
    # Written once: places read them several times, and each would encode anew. A task encodes some rows, whatever their files hold.
    encoded(spread(fine, "id", n=need), encode, batch).write.mode("overwrite").parquet(f"{store.root}/drafts/encoded_source={source}")
    good = store.spark.read.schema(ENCODED).parquet(f"{store.root}/drafts/encoded_source={source}")
    # Places go by the hash of the id, so neither they nor the hold-out depend on the layout of the files.
    placed = ordinals(good.withColumn("_all", F.lit(0)), ["_all"], [], "seq", "_at").where(F.col("_at") <= need).withColumns({"val": F.col("_at") <= C.HOLD_OUT, "seq": F.col("_at") + (before - 1)}).drop("_all", "_at")
    store.stage(placed, source)
    stats = {r.state: r.n for r in drafts.groupBy("state").agg(F.count("*").alias("n")).collect()}
    stats = {k: stats.get(k, 0) for k in ("ok", "failed", "dropped", "no_caption")} | {"ok": need}
    stats |= {"beyond": n - need} if target else {}
    store.progress(source, stats)
    return stats
