"""An index of the keys that a stream has taken (STM-05, STM-12, JOI-03, JOI-05): sorted runs with Bloom filters, compacted by levels.

    root/runs/<run>/p=<prefix>/      keys of a run, dealt by the first bits of their hash and sorted by it
    root/filters/<run>/              a Bloom filter for each prefix
    root/log/<version>.json          runs: name, level, batches, keys, bits of the prefix

A batch adds a run of level 0. FANOUT runs of a level are merged into one of the next, so there are FANOUT runs a level at most
and as many levels as the logarithm of the batches. A run has a prefix for about PREFIX_KEYS keys, and so a file for as many,
whatever number of batches it holds.

A lookup probes the filters first, prefix by prefix: a key that no run may hold is new, and costs no read of keys. The
rest (known keys, and 1 in 100 of the others) are joined with the prefixes and runs that may hold them, by the keys themselves, so
answers are exact. A batch that runs again replaces its own run: lookups for batch n leave its run out as long as it has not
been merged, and `add` is idempotent. Null keys are keys like others. Runs that no newest version names are removed by `vacuum`.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.operators.log import Log
from loomspan.operators.tables import spread

#: Runs of a level that are merged; keys of a prefix; bits of a filter for each key, and of these those that a key sets.
FANOUT, PREFIX_KEYS, BITS, PROBES = 8, 500_000, 10, 7
#: Prefixes of a lookup that are named one by one; beyond, its runs are read whole.
NAMED = 10_000


def levels(runs: list[dict], fanout: int) -> list[dict] | None:
    """The runs to merge next: the oldest `fanout` of the lowest level that has so many; None where none has."""
    for level in sorted({r["level"] for r in runs}):
        of = [r for r in runs if r["level"] == level]
        if len(of) >= fanout:
            return of[:fanout]
    return None


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Bits [keys, PROBES] of a filter of `size` bits that a 64-bit hash sets."""
    h = h.view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (mixed ^ (mixed >> np.uint64(29))) | np.uint64(1)
    return ((mixed[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(h: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(h) * BITS // 8) * 8), bool)
    bits[_places(h, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8)).astype(bool)
    return bits[_places(h, len(bits))].all(axis=1)


def _bits(n: int) -> int:
    """Bits of a prefix that leave about PREFIX_KEYS of n keys to each."""
    return max(0, math.ceil(math.log2(max(1, n) / PREFIX_KEYS)))


class KeyIndex:
    def __init__(self, spark: SparkSession, root: str, keys: StructType):
        self.spark, self.log, self.keys = spark, Log(spark, root), keys
        self.root = self.log.root
        self.held: list[DataFrame] = []

    @property
    def names(self) -> list[str]:
        return self.keys.fieldNames()

    def runs(self) -> list[dict]:
        entry = self.log.entry()
        return entry["runs"] if entry else []

    def _hashed(self, rows: DataFrame, bits: int) -> DataFrame:
        """Keys with their hash and the prefix that the hash's first bits name."""
        h = F.xxhash64(*self.names)
        p = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
        return rows.select(*self.names, h.alias("_h"), p.alias("p"))

    def _read(self, run: dict) -> DataFrame:
        return self.spark.read.schema(StructType([*self.keys.fields]).add("_h", "long").add("p", "long")).parquet(f"{self.root}/runs/{run['name']}")

    def _write(self, rows: DataFrame, n: int, level: int, batches: list[int]) -> dict:
        """A run of the distinct keys in rows, and its filters."""
        bits = _bits(n)
        run = {"name": f"r{uuid.uuid4().hex}", "level": level, "batches": batches, "bits": bits}
        dealt = self._hashed(rows, bits).repartitionById(1 << bits, F.col("p").cast("int")).sortWithinPartitions("p", "_h")
        dealt.write.partitionBy("p").parquet(f"{self.root}/runs/{run['name']}")
        written = self._read(run)
        schema = pa.schema([("p", pa.int64()), ("filter", pa.binary()), ("keys", pa.int64())])

        def build(group: pa.Table) -> pa.Table:
            h = group["_h"].combine_chunks().to_numpy()
            return pa.table([pa.array([group["p"][0].as_py()]), pa.array([bloom(h)], pa.binary()), pa.array([len(h)])], schema=schema)

        # A prefix holds about PREFIX_KEYS hashes, so a group is bounded; a task gets some of them, whatever the session's partitions.
        # Filters are shuffled into few files: a coalesce would have one task sort the hashes of all prefixes of a file.
        built = written.select("p", "_h").repartition(1 << bits, "p").groupBy("p").applyInArrow(build, "p long, filter binary, keys long")
        built.repartition(max(1, (1 << bits) // 64)).write.parquet(f"{self.root}/filters/{run['name']}")
        run["keys"] = self._filters(run).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
        return run

    def _filters(self, run: dict) -> DataFrame:
        return self.spark.read.schema("p long, filter binary, keys long").parquet(f"{self.root}/filters/{run['name']}")

    def known(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Those keys of rows that are in the index; for a batch that runs again, without what it added itself.

        The result reads a cached table of the keys that filters let pass, until `release`.
        """
        runs = [r for r in self.runs() if r["keys"] and r["batches"] != [batch]]
        none = self.spark.createDataFrame([], self.keys)
        if not runs:
            return none
        n = rows.count()
        wanted = spread(rows.select(*self.names), *self.names, rows=PREFIX_KEYS, n=n).distinct()
        maybe = []
        kind = StructType([*self.keys.fields]).add("_h", "long").add("p", "long").add("run", "string")
        names = self.names
        for bits in sorted({r["bits"] for r in runs}):
            # A batch may have far more keys than the runs: its groups have longer prefixes then, each with its run's filters.
            more = max(0, _bits(n) - bits)
            keyed = self._hashed(wanted, bits).withColumn("_q", F.shiftrightunsigned("_h", 64 - bits - more) if bits + more else F.lit(0).cast("long")).repartition(1 << (bits + more), "_q")
            filters = functools.reduce(DataFrame.union, [self._filters(r).select("p", "filter", F.lit(r["name"]).alias("run")) for r in runs if r["bits"] == bits])
            filters = filters.join(keyed.select("p").distinct(), "p", "left_semi")
            filters = filters.select("filter", "run", F.explode(F.sequence(F.shiftleft("p", more), F.shiftleft("p", more) + ((1 << more) - 1))).alias("_q"))

            def probe(keys: pa.Table, found: pa.Table) -> pa.Table:
                keys = keys.select([*names, "_h", "p"])
                h = keys["_h"].combine_chunks().to_numpy() if len(keys) else np.zeros(0, np.int64)
                out = []
                for run, f in zip(found["run"].to_pylist(), found["filter"].to_pylist(), strict=True):
                    some = keys.take(pa.array(np.flatnonzero(may_hold(f, h)))) if len(h) else keys
                    out.append(some.append_column("run", pa.array([run] * len(some), pa.string())))
                return pa.concat_tables(out) if out else keys.slice(0, 0).append_column("run", pa.array([], pa.string()))

            # A group: the batch's keys of one prefix, and a filter for each run that has it.
            maybe.append(keyed.groupBy("_q").cogroup(filters.groupBy("_q")).applyInArrow(probe, kind))
        maybe = functools.reduce(DataFrame.union, maybe).persist()
        self.held.append(maybe)
        named = maybe.select("run", "p").distinct().limit(NAMED + 1).collect()
        by_run: dict[str, list[int]] = {}
        for r in named:
            by_run.setdefault(r.run, []).append(r.p)
        parts = []
        for r in runs:
            if r["name"] in by_run or len(named) > NAMED:
                held = self._read(r).where(F.col("p").isin(by_run[r["name"]])) if len(named) <= NAMED else self._read(r)
                parts.append(held.select(*self.names, F.lit(r["name"]).alias("run")))
        if not parts:
            return none
        held = functools.reduce(DataFrame.union, parts)
        a, b = maybe.alias("a"), held.alias("b")
        same = F.col("a.run") == F.col("b.run")
        for c in self.names:
            same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, same, "left_semi").select(*self.names).distinct()

    def release(self) -> None:
        """Drops what lookups have cached."""
        while self.held:
            self.held.pop().unpersist()

    def add(self, rows: DataFrame, batch: int) -> dict:
        """The keys of rows as the run of a batch, instead of one that the batch added before; then merges that are due."""
        runs = self.runs()
        if any(batch in r["batches"] and len(r["batches"]) > 1 for r in runs):
            return self.log.entry()  # merged already, so it was complete
        wanted = spread(rows.select(*self.names), *self.names, rows=PREFIX_KEYS).distinct().persist()
        run = self._write(wanted, wanted.count(), 0, [batch])
        wanted.unpersist()
        entry = self.log.commit(lambda now: {"runs": [*[r for r in (now or {"runs": []})["runs"] if r["batches"] != [batch]], run]})
        while due := levels(entry["runs"], FANOUT):
            entry = self._merge(due)
        return entry

    def _merge(self, due: list[dict]) -> dict:
        rows = functools.reduce(DataFrame.union, [self._read(r).select(*self.names) for r in due])
        if all(r["keys"] == 0 for r in due):
            run = {**due[0], "level": due[0]["level"] + 1, "batches": [b for r in due for b in r["batches"]]}
        else:
            n = sum(r["keys"] for r in due)
            run = self._write(spread(rows, *self.names, rows=PREFIX_KEYS, n=n).distinct(), n, due[0]["level"] + 1, [b for r in due for b in r["batches"]])
        gone = {r["name"] for r in due}

        def change(now: dict) -> dict:
            kept = [r for r in now["runs"] if r["name"] not in gone]
            return {"runs": [run, *kept]}

        return self.log.commit(change)

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Removes runs that the newest version doesn't name and that are older than `hours`."""
        named = {r["name"] for r in self.runs()}
        self.log.vacuum("filters", named, hours)
        return self.log.vacuum("runs", named, hours)
