"""Line dedup: of a line that several documents hold, the document with the smallest id keeps it.

Lines become 128-bit hashes of their keys (stripped of ASCII white space, A-Z lower-cased). The hashes are dealt by
ranges of (hash, document, position), so a line that a third of all documents hold is spread over as many tasks as its
rows need, and sorted by the same columns inside a task. A task streams through its rows and remembers one thing: the
document that holds the hash at hand first. A run that a border cuts is settled by what the tasks left and right of it say
about their first and last runs: two rows a task. What comes back is no text but a bitmap of kept lines for each
document, as alternating run lengths (`encode`), which the texts are cut by.

The smallest doc_id that holds a key keeps all its lines with that key, in every row of that id; a null id is larger than all
others. Null and empty texts are one empty line, which is too short to be dropped. Repeated rows (equal id and text) share
one bitmap. Lines, texts and documents have no length limit; an empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points that a key has at least.
LEAST = 10
#: What is stripped, and the letters that are folded.
STRIPPED, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: MB of input files whose line hashes one task takes.
HASHES_MB = 24
#: What a row of the stream's output says: this line goes; it goes if the key stands in a smaller document left of the border; smallest document of a run at a border.
GOES, OPEN, BORDER = 0, 1, 2
STREAMED = "kind byte, h1 long, h2 long, doc_id long, t1 long, t2 long, pos int"
BITMAPS = "_doc long, _t1 long, _t2 long, n_dropped long, keep binary"


def _identity() -> list:
    """Columns that tell rows apart: the id and 128 bits of the text. Rows that agree in them have the same lines to drop."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("text"), text).alias("_t2")]


def hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2, doc_id, t1, t2, pos: a row per line whose key is long enough."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, t1, t2 = _identity()
    lines = docs.select(d.alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(STRIPPED)), UPPER, UPPER.lower())
    keyed = lines.select("doc_id", "t1", "t2", "pos", key.alias("key")).where(F.char_length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "t1", "t2", "pos")


def _first_occurrences(batches):
    """Rows sorted by hash, document, text and position: GOES, OPEN and BORDER rows of this range."""
    schema = pa.schema([("kind", pa.int8()), *[(n, pa.int64()) for n in ("h1", "h2", "doc_id", "t1", "t2")], ("pos", pa.int32())])
    run = None  # (h1, h2, id, id is null) of the run at hand
    first = True  # it is the first run of the range

    def border(of):
        return pa.RecordBatch.from_arrays([pa.array([BORDER], pa.int8()), pa.array([of[0]]), pa.array([of[1]]), pa.array([None if of[3] else of[2]], pa.int64()), *[pa.array([0], pa.int64())] * 2, pa.array([0], pa.int32())], schema=schema)

    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        h1, h2 = (rb.column(i).to_numpy() for i in (0, 1))
        null = rb.column(2).is_null().to_numpy(zero_copy_only=False)
        doc = rb.column(2).fill_null(0).to_numpy()
        starts = np.append(run is None or (h1[0], h2[0]) != run[:2], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        of = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # row where the run of a row starts, -1: in a batch before
        least, no_id = doc[of], null[of]
        if run is not None:
            least, no_id = np.where(of < 0, run[2], least), np.where(of < 0, run[3], no_id)
        later = (doc != least) | (null != no_id)
        begun = np.flatnonzero(starts)
        in_first = np.arange(n) < (begun[1] if first and run is None and len(begun) > 1 else begun[0] if first and run is not None and len(begun) else n if first else 0)
        kind = np.where(later, GOES, OPEN).astype(np.int8)
        out = np.flatnonzero(later | in_first)
        if len(out):
            taken = rb.take(pa.array(out))
            yield pa.RecordBatch.from_arrays([pa.array(kind[out]), *taken.columns], schema=schema)
        if first and len(begun) > (run is None):
            yield border(run or (int(h1[0]), int(h2[0]), int(doc[0]), bool(null[0])))
            first = False
        run = (int(h1[-1]), int(h2[-1]), int(least[-1]), bool(no_id[-1]))
    if run is not None:
        yield border(run)


def dropped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t1, t2, pos: the lines that go. Repeated rows may name a line more than once."""
    order = ["h1", "h2", F.col("doc_id").asc_nulls_last(), "t1", "t2", "pos"]
    dealt = hashes(docs, least).repartitionByRange(common.parts_for(docs, HASHES_MB), *order).sortWithinPartitions(*order)
    streamed = common.written(dealt.mapInArrow(_first_occurrences, STREAMED))
    # Two rows a task: a broadcast bounded by the number of tasks.
    borders = streamed.where(F.col("kind") == BORDER).groupBy(F.col("h1").alias("b1"), F.col("h2").alias("b2")).agg(F.min("doc_id").alias("_least"))
    pending = streamed.where(F.col("kind") == OPEN).join(F.broadcast(borders), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")))
    late = pending.where(F.col("_least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_least"))))
    lines = ["doc_id", "t1", "t2", "pos"]
    return streamed.where(F.col("kind") == GOES).select(*lines).union(late.select(*lines))


def encode(gone: np.ndarray) -> bytes:
    """Bitmap of kept lines from the sorted places of those that go: lengths of kept and dropped runs in turn, 7 bits a byte; all lines after the last run stay."""
    gone = gone[np.append(True, gone[1:] != gone[:-1])] if len(gone) else gone
    begins = np.flatnonzero(np.append(True, np.diff(gone) > 1)) if len(gone) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(gone)))
    heads = gone[begins]
    kept = heads - np.append(0, (heads + lengths)[:-1]) if len(heads) else heads
    out = bytearray()
    for x in np.column_stack([kept, lengths]).ravel().tolist():
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def decode(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of n lines stays."""
    keep = np.ones(n, bool)
    at, x, shift, stays = 0, 0, 0, True
    for b in bitmap or b"":
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            keep[at : at + x] = stays
            at, x, shift, stays = at + x, 0, 0, not stays
    return keep


def _bitmaps(batches):
    """Rows (doc_id, t1, t2, pos) sorted by all four -> a bitmap for each document."""
    schema = pa.schema([("_doc", pa.int64()), ("_t1", pa.int64()), ("_t2", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
    held, key = [], None

    def row(key, places):
        return (*key, len(np.unique(places)), encode(places))

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for rb in batches:
        n, rows = rb.num_rows, []
        if not n:
            continue
        null = rb.column(0).is_null().to_numpy(zero_copy_only=False)
        columns = [rb.column(0).fill_null(0).to_numpy(), null, rb.column(1).to_numpy(), rb.column(2).to_numpy()]
        pos = rb.column(3).to_numpy().astype(np.int64)
        ends = np.append(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1, n)
        at = 0
        for end in ends.tolist():
            this = (None if null[at] else int(columns[0][at]), int(columns[2][at]), int(columns[3][at]))
            if held and this != key:
                rows.append(row(key, np.concatenate(held)))
                held = []
            key = this
            held.append(pos[at:end])
            at = end
        if rows:
            yield made(rows)
    if held:
        yield made([row(key, np.concatenate(held))])


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """_doc, _t1, _t2, n_dropped, keep: a bitmap for each document (id and text) that loses a line."""
    keys = ["doc_id", "t1", "t2"]
    gone = dropped(docs, least)
    dealt = gone.repartition(common.parts_for(docs, HASHES_MB), *keys).sortWithinPartitions(*keys, "pos")
    return dealt.mapInArrow(_bitmaps, BITMAPS)


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with n_lines (before), n_dropped and `kept`, the text without the dropped lines; input columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "kept", "keep", "_doc", "_t1", "_t2")
    found = bitmaps(docs, least).withColumnsRenamed({"_doc": "_bdoc", "_t1": "_b1", "_t2": "_b2"})
    # The bitmaps are the built side, so texts are not sorted.
    same = F.col("_doc").eqNullSafe(F.col("_bdoc")) & (F.col("_t1") == F.col("_b1")) & (F.col("_t2") == F.col("_b2"))
    joined = docs.withColumns(dict(zip(("_doc", "_t1", "_t2"), _identity(), strict=True))).join(found.hint("shuffle_hash"), same, "left")
    joined = joined.select(*docs.columns, F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    text, bitmap = docs.columns.index("text"), len(docs.columns) + 1
    names = [*docs.columns, "n_dropped", "n_lines", "kept"]

    def shorten(batches):
        for rb in batches:
            n_lines, kept = [], []
            for t, b in zip(rb.column(text), rb.column(bitmap), strict=True):
                t, b = t.as_py() or "", b.as_py()
                n_lines.append(t.count("\n") + 1)
                if b:
                    lines = t.split("\n")
                    t = "\n".join(lines[i] for i in np.flatnonzero(decode(b, len(lines))).tolist())
                kept.append(t)
            yield pa.RecordBatch.from_arrays([*rb.columns[:bitmap], pa.array(n_lines, pa.int64()), pa.array(kept, pa.string())], names)

    return joined.mapInArrow(shorten, joined.drop("keep").schema.add("n_lines", "long").add("kept", "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND coalesce(doc_id <> min(doc_id) OVER (PARTITION BY key), min(doc_id) OVER (PARTITION BY key) IS NOT NULL) AS gone FROM k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""
