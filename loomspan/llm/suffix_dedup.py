"""Removes every byte that a repeated string of `length` bytes covers, exactly, across and inside documents.

A string of that length has at least one sampled place: the gram with the least hash among its grams. The
choice depends on the string alone, so equal strings are sampled at equal places and meet under one gram.
Strings that follow one another and share their sampled place are one context, aligned at the gram.

1. Each task samples its texts. Contexts with equal 128-bit hashes are collapsed where they stand, so a
   passage in many documents sends one row a batch.
2. Under each gram, contexts with equal hashes are collapsed into one weighted string: all its strings repeat, and
   their bytes are not compared. Grams with
   one light context are dropped.
3. For the grams with several contexts their bytes are fetched and indexed: the aligned Burrows-Wheeler transform
   (positional, since all contexts are aligned at their gram). Intervals of suffixes that start at the gram are expanded
   breadth first, a byte a level: where an interval splits, the common prefix is the level, so common prefixes are found by
   increasing value, from the gram's own bytes on. Breadth-first backward extension then prepends one byte a level to
   all intervals at once: each interval splits by its
   preceding byte (the transform's column), keeps its order, and common prefixes grow by one inside it.
   Intervals of one suffix are dropped at once, and the extension stops at the threshold: a string repeats where a
   neighbour's common prefix reaches `length`.
4. A gram with over HOT contexts is made longer: a string has room for `half` bytes more after the gram, or else before it, so
   each context gives at most two, each with a longer gram of its own and the strings that hold it; equal strings still
   meet. These go to 3, or, where still hot, on in 4, until a gram is nearly a string; what is left then (very many different
   contexts of one gram of length - 1 bytes) is keyed by the whole string's hash and collapsed as in 2.

Keys of rows, contexts and whole strings have 64, 128 and 128 hash bits; candidates of step 3 are compared by bytes.
Null texts are empty. Rows with equal doc_id and text count as two texts and are cut alike. Very long texts
are sampled by pieces that overlap. Texts shorter than `length` are never cut. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import _LETTER, _power, mixed

LENGTH = 200
GRAM = 40
#: Text that is sampled at once.
PIECE = 1 << 21
#: Distinct contexts of a gram over which its strings are dealt one by one.
HOT = 100_000
#: Hot grams that are broadcast at most.
HOT_GRAMS = 1_000_000
#: Contexts that one index holds, whole grams at a time.
INDEX_ROWS = 200_000
SAMPLE_MB = 8
BUCKETS_PER_PART = 8
HEAVY = np.uint64(1 << 63)


def pieces(offsets: np.ndarray, length: int, size: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) byte ranges: every string of `length` bytes lies in exactly one range."""
    out, now, held = [], [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for lo in range(a, max(a + 1, b - length + 1), size):
            hi = min(lo + size + length - 1, b)
            if hi - lo >= length:
                now.append((i, lo, hi))
                held += hi - lo
                if held >= size:
                    out.append(now)
                    now, held = [], 0
    return [*out, now] if now else out


def contexts(flat: np.ndarray, ranges: list[tuple[int, int, int]], length: int, gram: int):
    """(gram hash, context hash, range number, first string's place in flat, strings, place of the gram in the first)."""
    wide = length - gram + 1
    b = np.concatenate([flat[lo:hi] for _, lo, hi in ranges])
    sizes = np.array([hi - lo for _, lo, hi in ranges], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = len(b)
    up, down = _power(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[b] * up[:n], out=upto[1:])
    grams = mixed((upto[gram:] - upto[:-gram]) * down[: n - gram + 1])
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(keyed) // wide)
    grid = np.full(blocks * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(keyed)] = keyed
    grid = grid.reshape(blocks, wide)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    at = (np.minimum(after[:starts], before[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    delta = np.zeros(starts + 1, np.int32)
    np.add.at(delta, begins, 1)
    np.add.at(delta, begins + sizes - length + 1, -1)
    valid = np.cumsum(delta)[:-1] > 0
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first[begins] = True
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    p, q = np.flatnonzero(first), np.flatnonzero(last)
    body = mixed(mixed((upto[q + length] - upto[p]) * down[p]) + (q - p).astype(np.uint64))
    which = np.searchsorted(begins, p, side="right") - 1
    lows = np.array([lo for _, lo, _ in ranges], np.int64)
    return grams[at[p]], body, which, lows[which] + p - begins[which], q - p + 1, at[p] - p


def _collapse(h: np.ndarray, c: np.ndarray, key: np.ndarray, meta: np.ndarray):
    """Rows in order of (h, c), where each context starts, and each row's number of its context."""
    order = np.lexsort((c, h))
    h, c, key, meta = h[order], c[order], key[order], meta[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h, c, key, meta, np.flatnonzero(new), np.cumsum(new) - 1


def _packed(values: np.ndarray, bucket: np.ndarray, kind: int, schema: pa.Schema) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    which, first = np.unique(bucket, return_index=True)
    ends = [*first[1:].tolist(), len(values)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), kind, np.int8)), pa.array([values[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)], pa.binary())], schema=schema)


BUCKETED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
ROWS, RANGES = 0, 1


def _send(h, c, key, meta, buckets: int):
    """Bucketed rows of one batch: a row per context, and the ranges of those that repeat in the batch itself.

    meta: first string's place << 16 | (strings - 1) << 8 | place of the gram in the first string.
    """
    h, c, key, meta, at, number = _collapse(h, c, key, meta)
    count = np.bincount(number, minlength=len(at))
    again = count[number] > 1
    if again.any():
        ranges = np.stack([key[again], meta[again]], axis=1)
        yield _packed(ranges, key[again] % np.uint64(buckets), RANGES, BUCKETED)
    meta = meta[at] | np.where(count > 1, HEAVY, np.uint64(0))
    yield _packed(np.stack([h[at], c[at], key[at], meta], axis=1), h[at] % np.uint64(buckets), ROWS, BUCKETED)


FOUND = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("c", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("strings", pa.int32()), ("off", pa.int32()), ("heavy", pa.bool_())])
FOUND_DDL = "kind byte, h long, c long, key long, start long, strings int, off int, heavy boolean"
RANGE, CANDIDATE, HOT_CANDIDATE = 0, 1, 2


def _found(kind: int, h, c, key, meta, heavy) -> pa.RecordBatch:
    meta = meta & ~HEAVY
    i64 = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), i64(h), i64(c), i64(key), i64(meta >> np.uint64(16)), pa.array((((meta >> np.uint64(8)) & np.uint64(255)) + np.uint64(1)).astype(np.int32)), pa.array((meta & np.uint64(255)).astype(np.int32)), pa.array(heavy)], schema=FOUND)


def _meet(bucketed: DataFrame, parts: int, hot: int) -> DataFrame:
    """Ranges that repeat as whole contexts, and the contexts that must be compared with others of their gram."""

    def run(batches):
        rows = []
        for rb in batches:
            for kind, data in zip(rb.column(1).to_pylist(), rb.column(2), strict=True):
                values = np.frombuffer(data.as_py(), np.uint64)
                if kind == RANGES:
                    values = values.reshape(-1, 2)
                    none = np.zeros(len(values), np.uint64)
                    yield _found(RANGE, none, none, values[:, 0], values[:, 1], none > 0)
                else:
                    rows.append(values.reshape(-1, 4))
        if not rows:
            return
        rows = np.concatenate(rows)
        h, c, key, meta, at, number = _collapse(*(rows[:, i] for i in range(4)))
        flagged = meta >= HEAVY
        weight = np.bincount(number, 1 + flagged, minlength=len(at))
        heavy = weight > 1
        whole = heavy[number] & ~flagged  # a flagged row's own ranges came with it
        if whole.any():
            yield _found(RANGE, h[whole], c[whole], key[whole], meta[whole], np.ones(whole.sum(), bool))
        hh = h[at]
        new = np.append(True, hh[1:] != hh[:-1])
        each = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]  # distinct contexts of the gram
        for kind, which in ((CANDIDATE, (each > 1) & (each <= hot)), (HOT_CANDIDATE, each > hot)):
            if which.any():
                k = at[which]
                yield _found(kind, h[k], c[k], key[k], meta[k], heavy[which])

    return bucketed.repartition(parts, "bucket").mapInArrow(run, FOUND_DDL)


def expanded(h: np.ndarray, right: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in suffix order, common prefix of each with the row before it; one entry more ends the last interval).

    Level by level: each interval of two rows or more splits by its next byte, and rows that the level parts have the level as
    their common prefix. A row that ends leaves its interval at its end.
    """
    n = len(h)
    order = np.argsort(h, kind="stable")
    prefix = np.zeros(n + 1, np.int64)
    new = np.append(True, h[order[1:]] != h[order[:-1]]) if n else np.zeros(0, bool)
    for level in range(right.shape[1] + 1):
        interval = np.cumsum(new)
        live = np.flatnonzero(np.bincount(interval)[interval] > 1)  # rows in intervals of several
        if not len(live):
            break
        rows, inside = order[live], interval[live]
        symbol = np.where(held[rows] > level, right[rows, level].astype(np.int64) if level < right.shape[1] else 0, 256)
        by = np.argsort(inside * 257 + symbol, kind="stable")
        order[live], inside, symbol = rows[by], inside[by], symbol[by]
        parted = np.zeros(len(live), bool)
        parted[1:] = (inside[1:] == inside[:-1]) & ((symbol[1:] != symbol[:-1]) | (symbol[1:] == 256))
        prefix[live[parted]] = level
        new[live[parted]] = True
    return order, prefix


def repeats_at(h: np.ndarray, right: np.ndarray, held: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int):
    """(row, offset) of every string that another row has too, by breadth-first interval expansion and backward extension.

    Row: a context aligned at its gram h; `right` its bytes from the gram on (`held` of them), `left` the bytes before
    the gram, nearest first; its strings start low..high bytes before the gram.
    """
    order, prefix = expanded(h, right, held)
    found_row, found_at = [], []
    for level in range(left.shape[1] + 1):
        if level:
            keep = high[order] >= level
            if not keep.all():  # a row without more bytes leaves; its neighbours' common prefix is the least between them
                places = np.flatnonzero(keep)
                if not len(places):
                    break
                low_between = np.minimum.reduceat(prefix[: places[-1] + 1], np.append(0, places[:-1] + 1))
                order, prefix = order[places], np.append(low_between, 0)
            interval = np.cumsum(prefix[:-1] < gram + level - 1)
            symbol = left[order, level - 1]
            where = np.argsort(interval * 256 + symbol, kind="stable")
            same = np.zeros(len(where), bool)
            same[1:] = (interval[where[1:]] == interval[where[:-1]]) & (symbol[where[1:]] == symbol[where[:-1]])
            grown = np.zeros(len(where) + 1, np.int64)
            here = np.flatnonzero(same)
            i, j = where[here - 1] + 1, where[here]
            grown[here] = prefix[j] + 1
            if len(far := np.flatnonzero(i != j)):
                span = np.stack([i[far], j[far] + 1], axis=1).ravel()
                grown[here[far]] = np.minimum.reduceat(prefix, span)[::2] + 1
            order, prefix = order[where], grown
        deep = prefix >= gram + level
        alive = deep[:-1] | deep[1:]  # intervals of one row are dropped
        if not alive.all():
            keep = np.flatnonzero(alive)
            if not len(keep):
                break
            order, prefix = order[keep], np.append(np.where(deep[:-1], prefix[:-1], 0)[keep], 0)
        reach = prefix >= length
        hit = (reach[:-1] | reach[1:]) & (low[order] <= level) & (high[order] >= level)
        if hit.any():
            found_row.append(order[hit])
            found_at.append(np.full(hit.sum(), level))
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_at)


BODY = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("strings", pa.int32()), ("off", pa.int32()), ("heavy", pa.bool_()), ("body", pa.binary())])
BODY_DDL = "h long, key long, start long, strings int, off int, heavy boolean, body binary"


def _fetched(wanted: DataFrame, keyed: DataFrame, parts: int, length: int) -> DataFrame:
    """The bytes of each wanted context; a text's contexts travel to it, not the text to them."""

    def run(batches):
        for rb in batches:
            flat, offsets = common.utf8(rb.column(1))
            data = flat.tobytes()
            rows = []
            for key, at, items in zip(rb.column(0).to_pylist(), offsets[:-1].tolist(), rb.column(2).to_pylist(), strict=True):
                for x in items:
                    lo = at + x["start"]
                    rows.append((x["h"], key, x["start"], x["strings"], x["off"], x["heavy"], data[lo : lo + x["strings"] - 1 + length]))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BODY)], schema=BODY)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BODY)], schema=BODY)

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "start", "strings", "off", "heavy")).alias("items"))
    # Merge joins at every size: lists of places grow with the input, so they are never broadcast.
    joined = keyed.select(F.col("key").alias("k"), "text").hint("merge").join(lists, F.col("k") == F.col("key")).dropDuplicates(["k"])
    return joined.select("key", "text", "items").mapInArrow(run, BODY_DDL)


def _compared(bodies: DataFrame, parts: int, length: int, gram: int, rows_held: int) -> DataFrame:
    """Ranges (key, start, strings) of light contexts whose strings other contexts of their gram have."""
    wide = length - gram
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("strings", pa.int32())])

    def indexed(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        h = t["h"].to_numpy().view(np.uint64)
        key, start, strings, off = (t[c].to_numpy() for c in ("key", "start", "strings", "off"))
        heavy = t["heavy"].to_numpy(zero_copy_only=False)
        flat, at = [], 0
        sizes = strings.astype(np.int64) - 1 + length
        flat = np.frombuffer(b"".join([x.as_py() for c in t["body"].chunks for x in c]), np.uint8)
        at = np.cumsum(sizes) - sizes + off  # of the gram
        low, high = off - strings + 1, off
        held_right = length - low
        padded = np.append(flat, np.full(length, 255, np.uint8))
        right = padded[at[:, None] + np.arange(length)]
        left = padded[np.maximum(at[:, None] - 1 - np.arange(wide), 0)]
        row, offset = repeats_at(h, right, held_right, left, low, high, length, gram)
        light = ~heavy[row]
        row, offset = row[light], offset[light]
        place = start[row] + off[row] - offset
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        if len(row):
            new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))
            first = np.flatnonzero(new)
            run = np.diff(np.append(first, len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(key[row[first]]), pa.array(place[first]), pa.array(run.astype(np.int32))], schema=schema)

    def run(batches):
        held, n = [], 0
        for rb in batches:
            while rb.num_rows:
                if n < rows_held:
                    held.append(rb)
                    n += rb.num_rows
                    break
                # enough: the index ends where the last gram does
                end = held[-1].column(0)[-1].as_py()
                same = int((rb.column(0).to_numpy() == end).sum())
                if same:
                    held.append(rb.slice(0, same))
                    rb = rb.slice(same)
                    if not rb.num_rows:
                        break
                yield from indexed(held)
                held, n = [], 0
        if held:
            yield from indexed(held)

    return bodies.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, "key long, start long, strings int")


def ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, rows_held: int = INDEX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(docs with a row key, ranges (key, start, strings) of repeated strings in bytes)."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    parts = common.parts_for(docs, SAMPLE_MB)
    buckets = parts * BUCKETS_PER_PART

    def sample(batches):
        for rb in batches:
            keys = rb.column(0).to_numpy().view(np.uint64)
            flat, offsets = common.utf8(rb.column(1))
            for some in pieces(offsets, length):
                h, c, which, place, strings, off = contexts(flat, some, length, gram)
                text = np.array([i for i, _, _ in some])[which]
                meta = ((place - offsets[text]).astype(np.uint64) << np.uint64(16)) | ((strings - 1).astype(np.uint64) << np.uint64(8)) | off.astype(np.uint64)
                yield from _send(h, c, keys[text], meta, buckets)

    found = common.written(_meet(keyed.select("key", "text").mapInArrow(sample, "bucket int, kind byte, data binary"), parts, hot))
    out = found.where(F.col("kind") == RANGE).select("key", "start", "strings")
    bodies = _fetched(found.where(F.col("kind") != RANGE), keyed, parts, length)
    heavy = common.written(found.where(F.col("kind") == HOT_CANDIDATE).select("h").distinct())
    if heavy.isEmpty():
        return keyed, out.union(_compared(bodies, parts, length, gram, rows_held))
    bodies, few = common.written(bodies), _few(heavy)  # texts are shuffled once for both
    out = out.union(_compared(bodies.join(few, "h", "left_anti"), parts, length, gram, rows_held))
    out = out.union(_longer(bodies.join(few, "h", "left_semi").select(*BODY.names), parts, length, gram, hot, rows_held))
    return keyed, out


def _few(heavy: DataFrame) -> DataFrame:
    """Hot grams are told by broadcast while they are few; beyond, a merge join does."""
    return F.broadcast(heavy) if heavy.count() <= HOT_GRAMS else heavy.hint("merge")


def split(rows: pa.RecordBatch, length: int, gram: int, half: int) -> pa.RecordBatch:
    """BODY rows with grams of gram + half bytes: strings that have half bytes after their gram keep its start, the others' gram starts earlier."""
    out = []
    for h, key, start, strings, off, heavy, body in zip(*[c.to_pylist() for c in rows.columns], strict=True):
        early = min(max(off - (length - gram - half), 0), strings)  # strings with fewer than half bytes after the gram
        for first, n, to in ((0, early, off - half), (early, strings - early, off - early)):
            if n:
                part = body[first : first + n - 1 + length]
                name = hashlib.blake2b(part[to : to + gram + half], digest_size=8, key=(h & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")).digest()
                # The side is part of the key: a gram of one side is not compared with one of the other.
                out.append((int.from_bytes(name, "little", signed=True) ^ (first == 0 and n == early), key, start + first, n, to, heavy, part))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(BODY)], schema=BODY)


def _longer(bodies: DataFrame, parts: int, length: int, gram: int, hot: int, rows_held: int) -> DataFrame:
    """Ranges in hot grams, by grams that grow until they are not hot."""
    out = None
    while half := (length - gram) // 2:

        def grow(batches, gram=gram, half=half):
            for rb in batches:
                for at in range(0, rb.num_rows, 4096):
                    yield split(rb.slice(at, 4096), length, gram, half)

        bodies, gram = common.written(bodies.mapInArrow(grow, BODY_DDL)), gram + half
        heavy = common.written(bodies.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"))
        none, few = heavy.isEmpty(), _few(heavy)
        done = _compared(bodies if none else bodies.join(few, "h", "left_anti"), parts, length, gram, rows_held)
        out = done if out is None else out.union(done)
        if none:
            return out
        bodies = bodies.join(few, "h", "left_semi").select(*BODY.names)
    rest = _by_string(bodies, parts, length)
    return rest if out is None else out.union(rest)


def _by_string(bodies: DataFrame, parts: int, length: int) -> DataFrame:
    """Ranges in grams of very many contexts: each string is a row, collapsed by its hash."""
    buckets = parts * BUCKETS_PER_PART

    def strings(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, 4096):
                part = rb.slice(at, 4096)
                body = np.frombuffer(b"".join([x.as_py() for x in part.column(6)]), np.uint8)
                n = part.column(3).to_numpy().astype(np.int64)
                sizes = n - 1 + length
                begins = np.cumsum(sizes) - sizes
                up, down = _power(len(body) + 1)
                upto = np.zeros(len(body) + 1, np.uint64)
                np.cumsum(_LETTER[body] * up[: len(body)], out=upto[1:])
                place = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
                raw = (upto[place + length] - upto[place]) * down[place]
                heavy = np.repeat(part.column(5).to_numpy(zero_copy_only=False), n)
                key = np.repeat(part.column(1).to_numpy().view(np.uint64), n)
                start = np.repeat(part.column(2).to_numpy(), n) + place - np.repeat(begins, n)
                h, c = mixed(raw), mixed(raw ^ np.uint64(0x5851F42D4C957F2D))
                h, c, key, meta, first, number = _collapse(h, c, key, (start.astype(np.uint64) << np.uint64(16)) | np.where(heavy, HEAVY, np.uint64(0)))
                flagged = meta >= HEAVY
                weight = np.bincount(number, 1 + flagged, minlength=len(first))
                again = (weight[number] > 1) & ~flagged
                if again.any():
                    yield _packed(np.stack([key[again], meta[again]], axis=1), key[again] % np.uint64(buckets), RANGES, BUCKETED)
                meta = meta[first] & ~HEAVY | np.where(weight > 1, HEAVY, np.uint64(0))
                yield _packed(np.stack([h[first], c[first], key[first], meta], axis=1), h[first] % np.uint64(buckets), ROWS, BUCKETED)

    return _meet(bodies.mapInArrow(strings, "bucket int, kind byte, data binary"), parts, 1 << 62).where(F.col("kind") == RANGE).select("key", "start", "strings")


def cut(keyed: DataFrame, repeated: DataFrame, length: int = LENGTH) -> DataFrame:
    """keyed rows with the maximal removed spans and the remaining bytes."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"

    def run(batches):
        for rb in batches:
            flat, offsets = common.utf8(rb.column(1))
            data = memoryview(flat.tobytes())
            rows = []
            for key, lo, hi, items in zip(rb.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), rb.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in sorted((x["start"], x["start"] + x["strings"] - 1 + length) for x in items or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[lo + at : lo + a])
                    at = b
                kept.update(data[lo + at : hi])
                rows.append((key, hi - lo, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    lists = repeated.groupBy("key").agg(F.collect_list(F.struct("start", "strings")).alias("items")).withColumnRenamed("key", "k")
    return keyed.hint("merge").join(lists, F.col("key") == F.col("k"), "left").select("doc_id", "text", "items").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, repeated = ranges(common.table(spark, sf_dir, "documents"))
    return cut(keyed, repeated).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
