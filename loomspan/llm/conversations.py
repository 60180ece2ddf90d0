"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

A conversation's rows stand in order of turn (nulls first; equal turns by role, then text). Its first faults are blank (no
word character), duplicate (role and text seen earlier) and truncated (the last word character ends no sentence). Keeping
a row costs 0, giving it the role user or assistant 3, deleting it 4 (the only choice for blank and duplicate ones), and
inserting an empty user or assistant row anywhere 3; a truncated row that stays adds 3.

Rows are dealt to tasks by conversation and sorted there, so that a task streams through its conversations and holds some
at a time. Those are put in buckets by length (powers of two), and a bucket is solved at once: a time-major tensor of
row codes, the costs to the end of all conversations per turn and state (start, after s, after u, after a) from the last turn
to the first, then all traces from the first turn on, the least letter among the cheapest at each step. A letter fixes the
next state, so the traces are the ASCII-least of the cheapest.

A conversation of any length is one task's, because its result hashes all its texts in order; a long one takes memory of a
few bytes a row, since its texts go to a temporary file of the task (from SPOOL bytes on) and are read once more.

Null roles and texts are one space, as in the ids that damage is drawn from. A null conversation id is a conversation; an
empty role has no initial, so its row can't be kept as it is. Repeated rows are duplicates. Conversations without
rows keep zeros, an empty audit and the hash of nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Costs of the edits, and what a truncated row adds where it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space, ends of sentences, adjacent role initials that are right.
WHITE, ENDS, RIGHT = " \t\n\x0b\x0c\r", "[.!?]", ("su", "ua", "au")
#: Rows, and bytes of text, that a task solves at a time; bytes of a conversation's texts from which a file holds them.
ROWS, BYTES, SPOOL = 1 << 17, 32 << 20, 8 << 20
#: MB of input files whose conversations one task takes.
PART_MB = 16

S, U, A, OTHER, PAD = range(5)
MUST, CUT = 8, 16
#: States: start, after s, after u, after a. Where each initial leads from each state, -1: nowhere.
NEXT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: The one initial that can be given to a row, or inserted, at each state.
GIVEN = np.array([U, U, A, U])
FAR = 1 << 40
NAMES = {U: "user", A: "assistant"}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows by what crc32 of `conv_id:turn` does to them; dropped ones stay, marked `gone`."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, ENDS, "")).otherwise(text).alias("text"), fate.alias("_fate"))
    d = d.withColumn("_copy", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gone = F.col("_fate") == 0
    return d.select("conv_id", "turn", "role", F.when(gone, F.lit(None)).otherwise(F.col("text")).alias("text"), gone.alias("gone"))


def coded(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text[, gone]) with h1, h2 (hash of role and text), blank, cut and the role's initial as a number."""
    d = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = d.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "gone")
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)
    return d.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("row"), "role", "text").alias("h2"), (last == "").alias("blank"), (~last.rlike(ENDS)).alias("cut"), initial.cast("byte").alias("initial"))


def backward(codes: np.ndarray) -> np.ndarray:
    """codes [turns, conversations] -> cost to the end [turns + 1, states, conversations]."""
    turns, n = codes.shape
    cost = np.empty((turns + 1, 4, n), np.int64)

    def inserted(base):
        out = base.copy()
        out[2] = np.minimum(base[2], INSERT + base[3])
        out[3] = np.minimum(base[3], INSERT + base[2])
        out[0], out[1] = np.minimum(base[0], INSERT + out[2]), np.minimum(base[1], INSERT + out[2])
        return out

    end = np.full((4, n), FAR)
    end[0] = end[3] = 0
    cost[turns] = inserted(end)
    for t in range(turns - 1, -1, -1):
        cost[t] = inserted(np.minimum.reduce(_choices(codes[t], cost[t + 1])))
    return cost


def _choices(code: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [states, conversations] of deleting, keeping and renaming a turn's rows; a pad passes as a free deletion."""
    kind, pad = code & 7, (code & 7) == PAD
    stays = np.where((code & MUST) > 0, FAR, np.where((code & CUT) > 0, TRUNCATED, 0))
    delete = later + np.where(pad, 0, DELETE)
    keep, give = np.full_like(later, FAR), np.full_like(later, FAR)
    for s in range(4):
        to = NEXT[np.minimum(kind, OTHER), s]
        fits = (to >= 0) & ~pad
        keep[s] = np.where(fits, stays + np.take_along_axis(later, np.maximum(to, 0)[None], 0)[0], FAR)
        give[s] = np.where(pad, FAR, REROLE + stays + later[NEXT[GIVEN[s], s]])
    return delete, keep, give


def trace(codes: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Letters of the ASCII-least cheapest edits [steps, conversations], 0 where none."""
    turns, n = codes.shape
    state, every, steps = np.zeros(n, np.int64), np.arange(n), []
    for t in range(turns + 1):
        open_ = np.ones(n, bool)
        while open_.any():
            now = cost[t][state, every]
            letter = np.zeros(n, np.uint8)
            step = np.zeros(n, bool)
            to = state.copy()
            if t < turns:
                delete, keep, give = (c[state, every] for c in _choices(codes[t], cost[t + 1]))
                pad = (codes[t] & 7) == PAD
                gone = open_ & (delete == now)
                letter[gone & ~pad] = ord("D")
                step |= gone
            else:
                step |= open_ & ((state == 0) | (state == 3))
            given = NEXT[GIVEN[state], state]
            more = open_ & ~step & (INSERT + cost[t][given, every] == now)
            letter[more], to[more] = ord("I"), given[more]
            if t < turns:
                kept = open_ & ~step & ~more & (keep == now)
                letter[kept], to[kept] = ord("K"), NEXT[np.minimum(codes[t] & 7, OTHER), state][kept]
                named = open_ & ~step & ~more & ~kept
                letter[named], to[named] = ord("R"), given[named]
            steps.append(letter)
            state, open_ = to, more
    return np.stack(steps)


def solve(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(cost, audit) of conversations whose codes stand one after the other: buckets by length, a tensor each."""
    cost, audits = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    starts = np.cumsum(lengths) - lengths
    sizes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for size in np.unique(sizes[lengths > 0]).tolist():
        own = np.flatnonzero((sizes == size) & (lengths > 0))
        turns = int(lengths[own].max())
        t = np.arange(turns)[:, None]
        inside = t < lengths[own][None]
        tensor = np.where(inside, codes[np.where(inside, starts[own][None] + t, 0)], PAD)
        back = backward(tensor)
        cost[own] = back[0, 0]
        letters = np.ascontiguousarray(trace(tensor, back).T)
        for i, row in zip(own.tolist(), letters, strict=True):
            audits[i] = row[row > 0].tobytes()
    return cost, audits


def repaired(audit: bytes, rows):
    """(role, text) of each row that the edits leave, from the (role, text) of all rows."""
    state, rows = 0, iter(rows)
    for e in audit.decode():
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            state = NEXT["sua".index(role[0]), state]
        else:
            role = NAMES[int(GIVEN[state])]
            state = NEXT[GIVEN[state], state]
        yield role, text


class _Texts:
    """The (role, text) pairs of the rows at hand; in a file from SPOOL bytes on."""

    def __init__(self, spool: int):
        self.rows, self.size, self.file, self.spool = [], 0, None, spool

    def add(self, rows: list[tuple[str, str]], size: int) -> None:
        self.rows += rows
        self.size += size
        if self.file is None and self.size >= self.spool:
            self.file = tempfile.TemporaryFile()
        if self.file is not None and self.rows:
            pickle.dump(self.rows, self.file)
            self.rows = []

    def __iter__(self):
        if self.file is None:
            yield from self.rows
            return
        self.file.seek(0)
        while True:
            try:
                yield from pickle.load(self.file)
            except EOFError:
                return

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _figures(conv: np.ndarray, n: int, col: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(gaps, blank, duplicate, truncated, illegal of each of n conversations; codes of all rows), from rows in order."""
    rows = len(conv)
    same = np.append(False, conv[1:] == conv[:-1]) if rows else np.zeros(0, bool)
    blank = col["blank"]
    order = np.lexsort((np.arange(rows), col["h2"], col["h1"], conv))
    again = np.zeros(rows, bool)
    if rows:
        a, b = order[1:], order[:-1]
        again[a] = (conv[a] == conv[b]) & (col["h1"][a] == col["h1"][b]) & (col["h2"][a] == col["h2"][b])
    double = again & ~blank
    cut = col["cut"] & ~blank & ~double
    codes = col["initial"].astype(np.int64) | np.where(blank | double, MUST, 0) | np.where(cut, CUT, 0)
    pairs = {("sua".index(a), "sua".index(b)) for a, b in RIGHT}
    right = np.zeros(rows, bool)
    for a, b in pairs:
        right[1:] |= (col["initial"][:-1] == a) & (col["initial"][1:] == b)
    gaps = np.zeros(n, np.int64)
    there = ~col["no_turn"]
    if there.any():
        c, turn = conv[there], col["turn"][there]
        new = np.append(True, (c[1:] != c[:-1]) | (turn[1:] != turn[:-1]))
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        last = np.append(first[1:], len(c)) - 1
        gaps[c[first]] = turn[last] - turn[first] + 1 - np.bincount(c[new], minlength=n)[c[first]]
    count = lambda mask: np.bincount(conv[mask], minlength=n)
    return [gaps, count(blank), count(double), count(cut), count(same & ~right)], codes


def _repairs(batches, most: int, most_bytes: int, spool: int):
    """Coded rows sorted by conversation, turn, role and text -> RESULT rows."""
    names = ("turn", "no_turn", "h1", "h2", "blank", "cut", "initial")
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ids: list = []  # conversations at hand, the last one open
    conv: list = []  # arrays: the place in ids of each row
    held: dict[str, list] = {n: [] for n in names}
    texts: list[_Texts] = []
    rows = 0

    def solved():
        nonlocal rows
        col = {n: np.concatenate(x) if x else np.zeros(0, bool if n in ("blank", "cut", "no_turn") else np.int64) for n, x in held.items()}
        at = np.concatenate(conv) if conv else np.zeros(0, np.int64)
        figures, codes = _figures(at, len(ids), col)
        cost, audits = solve(codes, np.bincount(at, minlength=len(ids)))
        hashes = []
        for audit, own in zip(audits, texts, strict=True):
            h = hashlib.sha256()
            for k, (role, text) in enumerate(repaired(audit, own)):
                h.update((f"\n{role}:{text}" if k else f"{role}:{text}").encode())
            hashes.append(h.hexdigest())
            own.close()
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in (*figures, cost)], pa.array([a.decode() for a in audits]), pa.array(hashes)], schema=schema)
        ids.clear(), conv.clear(), texts.clear()
        for x in held.values():
            x.clear()
        rows = 0
        return out

    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        c = {f: rb.column(i) for i, f in enumerate(rb.schema.names)}
        null = c["conv_id"].is_null().to_numpy(zero_copy_only=False)
        number = c["conv_id"].fill_null(0).to_numpy()
        ends = np.append(np.flatnonzero((number[1:] != number[:-1]) | (null[1:] != null[:-1])) + 1, n)
        begin = 0
        for end in ends.tolist():
            this = None if null[begin] else int(number[begin])
            if not ids or ids[-1] != this:
                if rows >= most or sum(t.size for t in texts) >= most_bytes:
                    yield solved()
                ids.append(this)
                texts.append(_Texts(spool))
            part = {f: x.slice(begin, end - begin) for f, x in c.items()}
            here = np.flatnonzero(~part["gone"].to_numpy(zero_copy_only=False))
            begin = end
            if not len(here):
                continue
            part = {f: x.take(pa.array(here)) for f, x in part.items()}
            rows += len(here)
            conv.append(np.full(len(here), len(ids) - 1))
            for f in names:
                x = part["turn"] if f == "no_turn" else part[f]
                held[f].append(x.is_null().to_numpy(zero_copy_only=False) if f == "no_turn" else x.fill_null(0).to_numpy() if f == "turn" else x.to_numpy(zero_copy_only=False))
            texts[-1].add(list(zip(part["role"].to_pylist(), part["text"].to_pylist(), strict=True)), part["text"].nbytes)
    if ids:
        yield solved()


def repair(rows: DataFrame, most: int = ROWS, most_bytes: int = BYTES, spool: int = SPOOL) -> DataFrame:
    """RESULT: faults, cost, audit and hash of each conversation of rows (conv_id, turn, role, text, and `gone` for rows that only name their conversation).

    most, most_bytes: rows, and bytes of text, that are solved at a time; spool: bytes of a conversation's texts from which a file holds them.
    """
    columns = ["conv_id", "turn", "role", "text", "gone", "h1", "h2", "blank", "cut", "initial"]
    d = coded(rows).select(*columns)
    d = d.repartition(common.parts_for(rows, PART_MB), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return d.mapInArrow(lambda batches: _repairs(batches, most, most_bytes, spool), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(common.table(spark, sf_dir, "conversations")))
