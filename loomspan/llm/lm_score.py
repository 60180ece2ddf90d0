"""Language-model scoring by cross-entropy difference.

Two matched word bigram models, target (documents labelled good) and background (all documents), share one
vocabulary: every word and every bigram of the corpus, with no cap and no least count. A document's score is the mean
over its words of target loss minus background loss, in nats: low scores look like the target. A document's own
words do not count when it is scored, in either model (else a labelled document would vouch for itself, and
one that occurs twice would look like one that occurs once):

    p(b | a) = MIX * c(a b) / max(c(a), 1) + (1 - MIX) * (c(b) + ADD) / (n + ADD * (words + 1))

with c and n counted over all other documents; a start mark stands before the first word, and c(start) is the number of
texts with words.

1. A chunk is some consecutive texts of a task (CHUNK_BYTES). It sends its distinct words and bigrams, by 64-bit
   hashes, with its counts, to the keys' owners: each key once a chunk, however frequent it is.
2. An owner adds up and answers each chunk with the totals, in the order in which the chunk asked. Answers are
   written to one file a chunk in the shared folder.
3. The texts are read again; each chunk finds its file by its name, which holds a checksum of the chunk's content.
   Texts are never shuffled, and a chunk of other content than asked for is never scored wrongly: where the splits of
   the input have changed between the passes (executors lost or gained, other settings), chunks that were not asked for
   are missing, and all three steps run again. The scores are written, so that what reads them later depends on no split.

The labels' ids are broadcast where they are few (BROADCAST_BYTES), else joined by merge; both give the same rows.

Null and blank texts have 0 words and null losses. Repeated rows count and are scored each. Labels that contradict
each other, null ids and labels of unknown documents make no target; with no target all target counts are 0.
A text longer than a chunk is a chunk of its own. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mixed, word_hashes

MIX, ADD = 0.6, 0.5
#: Bytes of text that one chunk holds, bytes that are hashed at once, and MB of the input's files whose keys one task adds up.
CHUNK_BYTES = 8 << 20
STEP_BYTES = 1 << 20
COUNT_MB = 12
#: Owners in a task that adds up; it holds one owner's keys at a time beside the requests.
OWNERS_PER_PART = 4
#: Labelled ids are broadcast up to so many bytes of ids.
BROADCAST_BYTES = 32 << 20
START = np.uint64(1)
WORDS, PAIRS = 0, 1
ASKED = pa.schema([("owner", pa.int32()), ("chunk", pa.string()), ("kind", pa.int8()), ("data", pa.binary())])
ANSWERED = pa.schema([("chunk", pa.string()), ("kind", pa.int8()), ("owner", pa.int32()), ("data", pa.binary()), ("words", pa.int64()), ("every", pa.int64()), ("target", pa.int64())])
ANSWERED_DDL = "chunk string, kind byte, owner int, data binary, words long, every long, target long"


def small(values: np.ndarray) -> bytes:
    """Counts as a byte each; what is over 254 follows as (place, count)."""
    values = values.astype(np.uint64)
    far = np.flatnonzero(values > 254)
    return len(values).to_bytes(8, "little") + len(far).to_bytes(8, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + far.astype("<u8").tobytes() + values[far].astype("<u8").tobytes()


def unsmall(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(counts, where the next array starts)."""
    n, m = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little")
    at += 16
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    far = np.frombuffer(data, "<u8", m, at)
    out[far.astype(np.int64)] = np.frombuffer(data, "<u8", m, at + 8 * m).astype(np.int64)
    return out, at + 16 * m


class Chunk:
    """Words and bigrams of some texts. `wanted` tells the texts of the target."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray):
        """texts: (flat bytes, offsets) of consecutive texts."""
        hashes, counts = [], []
        for flat, offsets in texts:
            at = 0
            while at < len(offsets) - 1:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
                h, before = word_hashes(flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                hashes.append(h)
                counts.append(np.diff(before))
                at = to
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.wanted = wanted.astype(bool)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.first] = START
        # The start mark is a word before each text with words, so that its count comes like any other.
        starts = np.flatnonzero(self.counts > 0)
        self.keys, self.at = [], []
        for keys in (np.concatenate([self.words, np.full(len(starts), START)]), mixed(mixed(before) + self.words)):
            known, at = np.unique(keys, return_inverse=True)
            self.keys.append(known)
            self.at.append(at)
        self.of_text = [np.concatenate([self.text, starts]), self.text]

    def counted(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each key, in all texts and in those of the target."""
        n = len(self.keys[kind])
        return np.bincount(self.at[kind], minlength=n), np.bincount(self.at[kind][self.wanted[self.of_text[kind]]], minlength=n)

    def own(self, kind: int) -> np.ndarray:
        """For each place, how often its key stands in its own text."""
        key = self.at[kind].astype(np.int64) * max(len(self.counts), 1) + self.of_text[kind]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[back]

    def losses(self, totals: list[tuple[np.ndarray, np.ndarray]], size: int, n: tuple[int, int]) -> list[np.ndarray]:
        """Mean target loss and background loss of each text; totals: corpus counts of words and of bigrams."""
        m = len(self.words)
        own_word, own_pair = self.own(WORDS), self.own(PAIRS)
        place = np.empty(m, np.int64)  # of the word before, among words and start marks
        place[1:] = np.arange(m - 1) if m else 0
        place[self.first] = m + np.arange(len(self.first))
        out = []
        for side in (1, 0):
            mine = np.ones(len(self.counts), np.int64) if side == 0 else self.wanted.astype(np.int64)
            of = mine[self.text]
            word, pair = totals[WORDS][side], totals[PAIRS][side]
            b = word[self.at[WORDS][:m]] - own_word[:m] * of
            a = word[self.at[WORDS][place]] - own_word[place] * of
            both = pair[self.at[PAIRS]] - own_pair * of
            rest = n[side] - self.counts * mine
            p = MIX * both / np.maximum(a, 1) + (1 - MIX) * (b + ADD) / (rest[self.text] + ADD * (size + 1))
            out.append(np.bincount(self.text, -np.log(p), minlength=len(self.counts)) / np.maximum(self.counts, 1))
        return out


def chunks(batches, size: int):
    """(name, doc ids, Chunk) of consecutive texts; the name holds the task, the place and a checksum of what is in it.

    A text goes to the chunk before it while both fit in `size`, wherever Arrow batches end.
    """
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    ids, texts, wanted, held, crc = [], [], [], 0, 0
    for rb in batches:
        at = 0
        while at < rb.num_rows:
            flat, offsets = common.utf8(rb.column(1).slice(at))
            n = min(int(np.searchsorted(offsets, size - held, side="right")) - 1, rb.num_rows - at)
            if n <= 0 and ids:
                flags = np.concatenate(wanted)
                yield f"{task:07d}-{number:05d}-{zlib.crc32(flags.tobytes(), crc):08x}", pa.concat_arrays(ids), Chunk(texts, flags)
                number, held, crc = number + 1, 0, 0
                ids, texts, wanted = [], [], []
                continue
            n = max(n, 1)
            flat, offsets = flat[: offsets[n]].copy(), offsets[: n + 1].copy()
            ids.append(rb.column(0).slice(at, n))
            wanted.append(rb.column(2).slice(at, n).to_numpy(zero_copy_only=False).astype(np.uint8))
            texts.append((flat, offsets))
            crc = zlib.crc32(flat, crc)
            held += len(flat)
            at += n
    if ids:
        flags = np.concatenate(wanted)
        yield f"{task:07d}-{number:05d}-{zlib.crc32(flags.tobytes(), crc):08x}", pa.concat_arrays(ids), Chunk(texts, flags)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def asked(texts: DataFrame, owners: int, size: int) -> DataFrame:
    """What each chunk sends to each owner: sorted keys and its counts of them."""

    def run(batches):
        edges = np.arange(owners + 1, dtype=np.uint64)
        for name, _, chunk in chunks(batches, size):
            for kind in (WORDS, PAIRS):
                keys, (every, target) = chunk.keys[kind], chunk.counted(kind)
                # An owner ascends with the keys, so its share is a run of them.
                cuts = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32), edges).tolist()
                for o, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if i < j:
                        yield _rows([(o, name, kind, (j - i).to_bytes(8, "little") + keys[i:j].tobytes() + small(every[i:j]) + small(target[i:j]))], ASKED)
            del chunk, keys, every, target
        common.release()

    return texts.mapInArrow(run, "owner int, chunk string, kind byte, data binary")


def answered(requests: DataFrame, parts: int) -> DataFrame:
    """Totals of each request's keys, in its order, and for each owner a row without chunk: its words and their counts."""

    def run(batches):
        held: dict[tuple[int, int], list[tuple[str, bytes]]] = {}
        for rb in batches:
            for owner, chunk, kind, data in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                held.setdefault((owner, kind), []).append((chunk, data))
        for owner, kind in sorted(held):
            names, keys, sides = [], [], ([], [])
            for name, data in held.pop((owner, kind)):
                n = int.from_bytes(data[:8], "little")
                names.append(name)
                keys.append(np.frombuffer(data, np.uint64, n, 8))
                at = 8 + 8 * n
                for side in sides:
                    counts, at = unsmall(data, at)
                    side.append(counts)
            ends = np.cumsum([0, *map(len, keys)]).tolist()
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = []
            for side in sides:
                total = np.zeros(len(known), np.int64)
                np.add.at(total, at, np.concatenate(side))
                totals.append(total)
            for name, i, j in zip(names, ends[:-1], ends[1:], strict=True):
                yield _rows([(name, kind, owner, b"".join(small(t[at[i:j]]) for t in totals), None, None, None)], ANSWERED)
            if kind == WORDS:
                real = known != START
                yield _rows([(None, kind, owner, None, int(real.sum()), int(totals[0][real].sum()), int(totals[1][real].sum()))], ANSWERED)
        common.release()

    return requests.repartition(parts, "owner").mapInArrow(run, ANSWERED_DDL)


def kept(answers: DataFrame, parts: int, where: str) -> DataFrame:
    """Writes one file a chunk with its answers in its own order; returns the rows without chunk.

    A file appears under its name when it is whole; a task that runs again writes the same bytes.
    """
    schema = pa.schema([("words", pa.int64()), ("every", pa.int64()), ("target", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        fs, base = common.filesystem(where)
        fs.create_dir(base, recursive=True)
        now, held = None, []

        def put():
            if held:
                draft = f"{base}/.{now}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(draft, compression=None) as sink:
                    for kind, data in held:
                        packed = pa.compress(data, codec="lz4", asbytes=True)
                        sink.write(bytes([kind]) + len(packed).to_bytes(8, "little") + len(data).to_bytes(8, "little") + packed)
                try:
                    fs.move(draft, f"{base}/{now}")
                except OSError:  # a store that does not replace: another attempt has put the same bytes there
                    if fs.get_file_info(f"{base}/{now}").type.name != "File":
                        raise
                    fs.delete_file(draft)

        for rb in batches:
            for name, kind, _, data, *sums in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                if name is None:
                    yield _rows([tuple(sums)], schema)
                    continue
                if name != now:
                    put()
                    now, held = name, []
                held.append((kind, data))
        put()

    return answers.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "owner").mapInArrow(run, "words long, every long, target long")


#: What a task says whose chunk nobody has asked for, and times that the steps run.
MISSING, TRIES = "no counts of chunk", 4


def _totals(fs, path: str, chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    if fs.get_file_info(path).type.name != "File":
        raise LookupError(f"{MISSING} {path}")
    with fs.open_input_stream(path, compression=None) as file:
        data = file.read()
    found: tuple = (([], []), ([], []))
    at = 0
    while at < len(data):
        kind, packed, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little"), int.from_bytes(data[at + 9 : at + 17], "little")
        answer, place = pa.decompress(data[at + 17 : at + 17 + packed], decompressed_size=size, codec="lz4", asbytes=True), 0
        at += 17 + packed
        for side in found[kind]:
            counts, place = unsmall(answer, place)
            side.append(counts)
    out = [tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in found[kind]) for kind in (WORDS, PAIRS)]
    if any(len(out[k][0]) != len(chunk.keys[k]) for k in (WORDS, PAIRS)):
        raise ValueError(f"{path}: counts of other keys")
    return out


def _scored(texts: DataFrame, where: str, words: int, n: tuple[int, int], size: int) -> DataFrame:
    def run(batches):
        fs, base = common.filesystem(where)
        for name, ids, chunk in chunks(batches, size):
            blank = chunk.counts == 0
            losses = chunk.losses(_totals(fs, f"{base}/{name}", chunk), words, n) if len(chunk.words) else [np.zeros(len(blank))] * 2
            out = [pa.array(x, mask=blank) for x in (*losses, losses[0] - losses[1])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.counts.astype(np.int64)), *out], ["doc_id", "n_words", "target_loss", "background_loss", "difference"])
            del chunk
        common.release()

    return texts.mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, difference double")


def _rereadable(df: DataFrame) -> bool:
    """Whether a plan is files, filters and columns alone: then it gives the same rows in the same partitions when it runs again."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in ("Project", "Filter") and not plan.nodeName().startswith(("LogicalRelation", "RelationV2")):
            return False
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return True


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids (good) that are labelled good and never bad."""
    held = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    return held.where("lo = 1 and hi = 1").select(F.col("doc_id").cast("long").alias("good"))


def score(docs: DataFrame, labels: DataFrame, chunk_bytes: int = CHUNK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, difference of each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Chunks must come again as they were, so what is not read from files is written first.
    docs = docs if _rereadable(docs) else common.written(docs)
    parts = common.parts_for(docs, COUNT_MB)
    good = common.written(good_ids(labels))
    few = 8 * good.count() <= broadcast_bytes
    texts = docs.join(F.broadcast(good) if few else good.hint("merge"), F.col("doc_id") == F.col("good"), "left").select("doc_id", "text", F.col("good").isNotNull().alias("wanted"))
    texts = texts if few else common.written(texts)
    for attempt in range(TRIES):
        where = common.shared_dir(spark)
        sums = common.written(kept(answered(asked(texts, OWNERS_PER_PART * parts, chunk_bytes), parts), parts, where))
        words, every, target = (x or 0 for x in sums.agg(F.sum("words"), F.sum("every"), F.sum("target")).first())
        try:
            # A plan of its own: splits are chosen when a plan is made, for both passes alike.
            return common.written(_scored(texts.select("*"), where, words, (every, target), chunk_bytes))
        except Exception as e:
            if MISSING not in str(e) or attempt == TRIES - 1:
                raise
    raise AssertionError("unreachable")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
