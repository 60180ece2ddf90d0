"""N-gram Jaccard join with a token-group matrix, exact for every pair of texts.

1. Texts with equal shingle sets are one set. Sets whose sizes allow a link are partitioned by segments of
   the hash space: at the threshold two sets differ in at most D tokens, so of D + 1 + z segments at least z + 1
   agree. Each set sends the hash of each of its segments; sets that share one are candidates. Within a task sets
   of one segment are tied to one of them, which alone is sent, so a segment that very many sets share costs a row a
   task. Shingles that are
   frequent in a sample are left out of the segments of all sets. That loses no pair, whatever is left out, since
   sets without them differ in no more tokens; it keeps common lines from making candidates.
2. Candidates that hang together are a cluster of similar sets; clusters over TOKENS tokens are dealt to chunks.
3. In a chunk the sets form groups around leaders. The token-group matrix holds each group's token union; a
   query's overlap with it bounds its overlap with every member, and only groups whose bound reaches the
   threshold are opened. A group is left at its first link, since its members are linked already.
4. Where a cluster has several chunks, sets outside its main component query all other chunks.

So segments find which sets may be similar, and the matrix decides, group by group, which are. Copies are never expanded into
pairs, and a group's members are not paired with each other: a large group costs
its size. No partner is capped. Null and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; repeated rows have one component. Rows are told apart by their sets, never by
doc_id: rows with one doc_id and different texts link each by its own text. Rows with a null doc_id link others and get the
component's smallest known id (null where it has none). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mixed, set_key, shingle_sets

#: Tokens of a chunk, and so of a token-group matrix.
TOKENS = 1_000_000
#: MB of the input's files whose signatures one task holds.
SIGNATURE_MB = 4
BUCKETS_PER_PART = 8
BATCH_BYTES = 1 << 20
#: Documents in which frequent shingles are looked for, and how many of them are left out of segments at most.
SAMPLE_DOCS, FREQUENT = 10_000, 65_536
#: A shingle is frequent from so many of the sampled documents on.
FREQUENT_DOCS = 4
SIGNED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("pairs", pa.binary())])
SIGNS, EDGES = 0, 1
#: A signature travels without what its bucket says, cut to 32 bits: one that agrees by chance makes a candidate, which is compared.
SIGN = np.dtype([("rest", "<u4"), ("key", "<u8")])


def classes(percent: int, upto: int) -> list[tuple[int, int, int]]:
    """(smallest size, segments, spare segments) by size class; linked sets are in one class or in neighbours."""
    bounds = [1, 2]
    while bounds[-1] <= upto:
        bounds.append(max(100 * (bounds[-1] - 1) // percent + 1, bounds[-1] + 1))
    bounds += [max(100 * (bounds[-1] - 1) // percent + 1, bounds[-1] + 1)]
    out = []
    for lo, up in zip(bounds, bounds[1:], strict=False):
        hi = up - 1
        differ = (hi + 100 * hi // percent) * (100 - percent) // (100 + percent)
        spare = (differ + 9) // 10
        out.append((lo, differ + 1 + spare, spare))
    return out


class Signer:
    """Segment hashes of a set: as a member of its own size class, and as a visitor of the class below."""

    def __init__(self, percent: int, frequent: np.ndarray):
        self.percent, self.known, self.frequent = percent, classes(percent, 64), frequent
        self.lows = np.array([c[0] for c in self.known])

    def _segments(self, tokens: np.ndarray, m: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, tokens) of each of m segments."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens), dtype=np.uint64)])
        edges = np.searchsorted(((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        return mixed(mixed(sums[edges[1:]] - sums[edges[:-1]] + np.uint64(tag << 40)) + np.arange(m, dtype=np.uint64)), np.diff(edges)

    def sign(self, tokens: np.ndarray) -> np.ndarray:
        """Linked sets agree in spare + 1 segments at least, empty and thin ones included.

        What is thin depends on the class alone, so that both sets of a pair decide alike. Where a set has more thin segments
        than are spare, all that agree may be thin; then they are so in both sets, and both fall back: first to segments of
        all tokens, and where those have too many thin ones too, to triples of them.
        """
        if len(tokens) > self.known[-2][0]:
            self.known = classes(self.percent, 2 * len(tokens))
            self.lows = np.array([c[0] for c in self.known])
        own = int(np.searchsorted(self.lows, len(tokens), side="right")) - 1
        rare = tokens
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            rare = tokens[self.frequent[at] != tokens]
        out = []
        for c in (own, own - 1) if own else (own,):
            low, m, spare = self.known[c]
            least = 2 if low >= 5 * m else 1  # thin segments must stay rarer than the spare ones
            for k, some in enumerate((rare, tokens)):
                hashes, held = self._segments(some, m, 4 * c + k)
                thin = np.flatnonzero(held < least)
                out.append(hashes[held >= least])
                if len(thin) <= spare:
                    break
            else:
                together = np.array(list(itertools.combinations(thin.tolist(), min(spare + 1, 3))))
                out.append(mixed(hashes[together].sum(axis=1, dtype=np.uint64) + np.uint64((4 * c + 2) << 40)))
        return np.concatenate(out)


def _sets(rb: pa.RecordBatch, column: int, k: int):
    """(row, set) of each row, some megabytes of text at a time."""
    at = 0
    while at < rb.num_rows:
        flat, offsets = common.utf8(rb.column(column).slice(at))
        n = max(1, int(np.searchsorted(offsets, BATCH_BYTES, side="right")) - 1)
        n = min(n, rb.num_rows - at)
        for i, s in enumerate(shingle_sets(flat[: offsets[n]], offsets[: n + 1], k)):
            yield at + i, s
        at += n


def sizes_and_keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the 128-bit key of each row's set, and the row's own key (`row_keyed`)."""

    def run(batches):
        for rb in batches:
            rows = [(len(s), *set_key(s)) for _, s in _sets(rb, 4, k)]
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], ["doc_id", "th", "_file", "_row", "n_shingles", "k1", "k2"])
        common.release()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), "_file", "_row", text).mapInArrow(run, "doc_id long, th long, _file long, _row long, n_shingles long, k1 long, k2 long")


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted shingles that a bounded sample of documents finds frequent; any answer gives right results."""
    sample = common.sampled(docs, SAMPLE_DOCS).select("text")

    def tokens(batches):
        for rb in batches:
            for _, s in _sets(rb, 0, k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["token"])
        common.release()

    counts = sample.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT_DOCS).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return np.sort(rows["token"].to_numpy().view(np.uint64))


def candidate_edges(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): sets, by the first half of their keys, that share a segment, as a forest per task."""
    parts = common.parts_for(docs, SIGNATURE_MB)
    buckets = parts * BUCKETS_PER_PART
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))  # FREQUENT longs at most

    def sign(batches):
        signer, seen, held, size = Signer(percent, frequent.value), set(), [], 0

        def dealt(rows, bucket, kind):
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            which, first = np.unique(bucket, return_index=True)
            ends = [*first[1:].tolist(), len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), kind, np.int8)), pa.array([rows[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)], pa.binary())], schema=SIGNED)

        def packed():
            nonlocal held, size
            firsts, edges = tied(np.concatenate(held))
            held, size = [], 0
            if len(edges):
                yield dealt(edges, mixed(edges[:, 0]) % np.uint64(buckets), EDGES)
            signs = np.empty(len(firsts), SIGN)
            signs["rest"], signs["key"] = (firsts[:, 0] // np.uint64(buckets)).astype(np.uint32), firsts[:, 1]
            yield dealt(signs, firsts[:, 0] % np.uint64(buckets), SIGNS)

        for rb in batches:
            for _, s in _sets(rb, 0, k):
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:  # a copy in this task; the set is known by now
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                sigs = signer.sign(s)
                held.append(np.stack([sigs, np.full(len(sigs), key[0] & 0xFFFFFFFFFFFFFFFF, np.uint64)], axis=1))
                size += len(sigs)
                if size >= 1 << 20:
                    yield from packed()
        if held:
            yield from packed()
        seen.clear()
        common.release()

    def join(batches):
        rows: tuple[list, list] = ([], [])
        for rb in batches:
            for bucket, kind, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), strict=True):
                if kind == EDGES:
                    rows[kind].append(np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2))
                else:
                    signs = np.frombuffer(x.as_py(), SIGN)
                    rows[kind].append(np.stack([signs["rest"].astype(np.uint64) | np.uint64(bucket << 32), signs["key"]], axis=1))
        edges = rows[EDGES]
        if rows[SIGNS]:
            edges.append(tied(np.concatenate(rows[SIGNS]))[1])
        if edges:
            edges = np.unique(np.concatenate(edges), axis=0)
            for at in range(0, len(edges), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(edges[at : at + (1 << 18), i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])
        common.release()

    signed = docs.select(F.col("text").cast("string")).mapInArrow(sign, "bucket int, kind byte, pairs binary")
    return signed.repartition(parts, "bucket").mapInArrow(join, "a long, b long").distinct()


def tied(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, smallest key) of each signature, and an edge from its other keys to that one."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    sig, key = pairs[order, 0], pairs[order, 1]
    start = np.append(True, sig[1:] != sig[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))
    other = key != key[first]
    return np.stack([sig[start], key[start]], axis=1), np.unique(np.stack([key[other], key[first[other]]], axis=1), axis=0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component. Labels spread along edges and jump to their label's label.

    Each round at least halves the longest way of labels, so rounds grow with the logarithm of the nodes.
    """
    edges = common.written(edges.select("a", "b").where("a <> b").distinct())
    common.cleared(edges.sparkSession)
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    # Nodes with a thousandth of the edges, and so 1,000 at most, are joined by broadcast: all others tie to one of a large group.
    heavy = common.written(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= max(1000, edges.count() // 500)).select("b"))
    some = not heavy.isEmpty()
    while True:
        of = labels.select(F.col("node").alias("b"), "root")
        near = (both.join(F.broadcast(heavy), "b", "left_anti") if some else both).join(of.hint("merge"), "b")
        if some:
            near = near.unionByName(both.join(F.broadcast(of.join(F.broadcast(heavy), "b", "left_semi")), "b"))
        near = near.groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        low = common.written(low)
        up = low.select(F.col("node").alias("n"), F.col("root").alias("r"))
        jumped = common.written(low.join(up, low.root == up.n, "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"), "was"))
        labels = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return labels


class Groups:
    """Sets in groups around leaders, with the matrix of tokens by groups.

    add() links a set with everything before it; links are kept as components. Tokens that only one set of the
    chunk has cannot overlap with anything: `shared` leaves them out, and sizes are kept beside.
    """

    def __init__(self, percent: int, n_tokens: int):
        """n_tokens: tokens are numbers below it, as `shared` makes them. of_token has a group, or a list of groups, of each."""
        self.percent, self.of_token, self.members, self.sets, self.sizes, self.up = percent, [None] * n_tokens, [], [], [], []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def linked(self, a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
        if self.percent * max(n, m) > 100 * min(n, m) or 100 * min(len(a), len(b)) < self.percent * max(n, m):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (n + m - both)

    def qualifying(self, tokens: np.ndarray, size: int) -> list[int]:
        """Groups whose token union holds enough of the query, most overlap first."""
        if 100 * len(tokens) < self.percent * size:
            return []
        overlap: dict[int, int] = {}
        of_token = self.of_token
        for t in tokens.tolist():
            g = of_token[t]
            if g is not None:
                if type(g) is int:
                    overlap[g] = overlap.get(g, 0) + 1
                else:
                    for x in g:
                        overlap[x] = overlap.get(x, 0) + 1
        need = self.percent * size
        return sorted((g for g, n in overlap.items() if 100 * n >= need), key=lambda g: (-overlap[g], g))

    def _enter(self, group: int, tokens: np.ndarray) -> None:
        of_token = self.of_token
        for t in tokens.tolist():
            g = of_token[t]
            if g is None:
                of_token[t] = group
            elif type(g) is int:
                if g != group:
                    of_token[t] = [g, group]
            elif g[-1] != group and group not in g:
                g.append(group)

    def query(self, tokens: np.ndarray, size: int, me: int | None = None):
        """A member of each qualifying group that the set links with; groups of the set's own component are passed over."""
        for g in self.qualifying(tokens, size):
            if me is not None and self.root(self.members[g][0]) == self.root(me):
                continue
            for m in self.members[g]:
                if self.linked(tokens, size, self.sets[m], self.sizes[m]):
                    yield g, m
                    break

    def add(self, tokens: np.ndarray, size: int) -> int:
        me = len(self.sets)
        self.sets.append(tokens)
        self.sizes.append(size)
        self.up.append(me)
        home = None
        for g, m in self.query(tokens, size, me):
            if home is None and m == self.members[g][0]:
                home = g
            a, b = sorted((self.root(me), self.root(m)))
            self.up[b] = a
        if home is None:
            home = len(self.members)
            self.members.append([me])
        else:
            self.members[home].append(me)
        self._enter(home, tokens)
        return me


def shared(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets without the tokens that only one of them has, as small numbers, and how many numbers there are."""
    if not sets:
        return [], 0
    every = np.concatenate(sets)
    every.sort()
    several = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    if not len(several):
        return [np.zeros(0, np.int32) for _ in sets], 0
    out = []
    for s in sets:
        at = np.minimum(np.searchsorted(several, s), len(several) - 1)
        out.append(at[several[at] == s].astype(np.int32))
    return out, len(several)


def _grouped(batches, keys: int):
    """(key, rows) of consecutive rows with equal first `keys` columns."""
    now, rows = None, []
    for rb in batches:
        columns = [c.to_pylist() for c in rb.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _tokens(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), k)[0]


def link_chunks(texts: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """texts (cluster, chunk, k1, k2, text) -> (node, root) by k1: components inside each chunk."""

    def run(batches):
        for _, rows in _grouped(batches, 2):
            found = {}
            while rows:
                k1, k2, text = rows.pop()
                if (k1, k2) not in found:
                    found[k1, k2] = _tokens(text or "", k)
            keys = sorted(found)
            sizes = [len(found[x]) for x in keys]
            sets, n_tokens = shared([found[x] for x in keys])
            del found
            groups = Groups(percent, n_tokens)
            for tokens, size in zip(sets, sizes, strict=True):
                groups.add(tokens, size)
            nodes, roots = [x[0] for x in keys], [keys[groups.root(i)][0] for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])
            large = n_tokens > 50_000
            del groups, sets, keys, nodes, roots, sizes  # before the next chunk is gathered
            if large:
                common.release()
        common.release()

    dealt = texts.select("cluster", "chunk", "k1", "k2", "text").repartition(parts, "cluster", "chunk").sortWithinPartitions("cluster", "chunk")
    return dealt.mapInArrow(run, "node long, root long")


def link_across(base: DataFrame, queries: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of different chunks of a cluster: queries (cluster, chunk, k1, text) against the chunk's own sets."""

    def run(batches):
        for _, rows in _grouped(batches, 2):
            nodes, out = [], []
            sets = [_tokens(text or "", k) for _, _, text in rows]
            rows = [(asks, node, len(s)) for (asks, node, _), s in zip(rows, sets, strict=True)]
            sets, n_tokens = shared(sets)
            groups = Groups(percent, n_tokens)
            for (asks, node, size), tokens in zip(rows, sets, strict=True):  # the chunk's own sets come first
                if not asks:
                    groups.add(tokens, size)
                    nodes.append(node)
                else:
                    out += [(node, nodes[m]) for _, m in groups.query(tokens, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            del groups, sets, rows
            common.release()

    rows = base.select("cluster", "chunk", F.lit(False).alias("asks"), "k1", "text").union(queries.select("cluster", "chunk", F.lit(True).alias("asks"), "k1", "text"))
    return rows.repartition(parts, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "asks", "k1").mapInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, k: int, percent: int, tokens: int = TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their set's key, distinct sets, (node, root) of the sets that were compared)."""
    docs = common.row_keyed(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "_file", "_row")
    parts = common.parts_for(docs, 4 * SIGNATURE_MB)
    rows = common.written(sizes_and_keys(docs, k))
    # A set's text is read from one of its rows, told by file and place.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "_file", "_row"))
    sets = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.max("n_shingles").alias("n"), row.alias("row"))
    # Written, since Catalyst would push joins of the sets below their aggregation, to all rows of a set with very many copies.
    sets = common.written(sets.select("k1", "k2", "n", F.col("row.doc_id").alias("d"), F.col("row.th").alias("h"), "row._file", "row._row"))
    nodes = components(candidate_edges(docs, k, percent)).select(F.col("node").alias("k1"), F.col("root").alias("cluster"))
    live = common.written(sets.join(nodes, "k1").select("cluster", "k1", "k2", "_file", "_row", "n"))
    totals = live.groupBy("cluster").agg(F.sum("n").alias("all"))
    live = live.join(totals, "cluster").withColumn("chunk", F.pmod(F.xxhash64("k1"), F.ceil(F.col("all") / tokens)))
    live = common.written(live.withColumn("several", F.col("all") > tokens).drop("all", "n"))
    texts = common.beside_rows(docs.select("text", "_file", "_row"), live, rows.count())
    texts = common.written(texts.select("cluster", "chunk", "k1", "k2", "text", "several"))
    common.cleared(docs.sparkSession)
    found = common.written(link_chunks(texts, parts, k, percent))
    if not live.where("several").isEmpty():
        found = common.written(_across(live, texts.where("several"), found, parts, k, percent))
    common.cleared(docs.sparkSession)
    return rows, sets, found


def link(docs: DataFrame, k: int, percent: int, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, sets, found = linked_sets(docs, k, percent, tokens)
    linked = common.written(sets.join(found.select(F.col("node").alias("k1"), "root").hint("merge"), "k1"))
    least = linked.groupBy("root").agg(F.min("d").alias("component"))
    alone = sets.join(found.select(F.col("node").alias("k1")).hint("merge"), "k1", "left_anti").select("k1", "k2", F.col("d").alias("component"))
    every = common.written(common.hot_join(linked, least, ["root"]).select("k1", "k2", "component").unionByName(alone))
    out = common.hot_join(rows.select("doc_id", "n_shingles", "k1", "k2"), every, ["k1", "k2"])
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int, percent: int, tokens: int = TOKENS) -> DataFrame:
    """Of docs (`row_keyed`) one row of each component: that with the smallest doc_id, unknown ids last, then hash of the text; and one of each id and text without shingles."""
    rows, sets, found = linked_sets(docs, k, percent, tokens)
    of = found.select(F.col("node").alias("k1"), "root").hint("merge")
    best = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h", "_file", "_row")).alias("row")
    first = sets.join(of, "k1").groupBy("root").agg(best).select("row._file", "row._row")
    alone = sets.join(of, "k1", "left_anti").select("_file", "_row")
    empty = rows.where("n_shingles = 0").groupBy("doc_id", "th").agg(F.min(F.struct("_file", "_row")).alias("row")).select("row._file", "row._row")
    return common.beside_rows(docs, first.union(alone).union(empty), rows.count())


def _across(live: DataFrame, texts: DataFrame, found: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """(node, root) over all chunks of clusters that have several; texts has the texts of their sets."""
    text = texts.select(F.col("k1").alias("node"), "text").dropDuplicates(["node"])
    several = common.written(live.where("several").select("cluster", "chunk", F.col("k1").alias("node"), "k2").join(found, "node"))
    # The chunks' largest components are compared through one set each, so that the main ones merge first.
    size = several.groupBy("cluster", "chunk", "root").agg(F.count("*").alias("n"))
    largest = size.groupBy("cluster", "chunk").agg(F.max(F.struct("n", "root"))["root"].alias("node")).drop("chunk")
    heads = several.join(largest, ["cluster", "node"]).join(text, "node").withColumn("k1", F.col("node"))
    first = link_chunks(heads.withColumn("chunk", F.lit(0).cast("long")), parts, k, percent).select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    inside = several.select(F.col("node").alias("a"), F.col("root").alias("b"))
    so_far = components(inside.union(first)).withColumnRenamed("root", "now")
    known = common.written(several.join(so_far, "node", "left").withColumn("now", F.coalesce("now", "node")))
    count = known.groupBy("cluster", "now").agg(F.count("*").alias("n"))
    main = count.groupBy("cluster").agg(F.max(F.struct("n", "now"))["now"].alias("main"))
    base = known.join(text, "node").withColumn("k1", F.col("node"))
    chunks = known.select("cluster", F.col("chunk").alias("to")).distinct()
    outside = known.join(main, "cluster").where("now <> main").join(text, "node")
    queries = outside.join(chunks, "cluster").where("to <> chunk").select("cluster", F.col("to").alias("chunk"), F.col("node").alias("k1"), "text")
    more = link_across(base, queries, parts, k, percent)
    every = components(inside.union(first).union(more)).select("node", F.col("root").alias("over"))
    return found.join(every, "node", "left").select("node", F.coalesce("over", "root").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"), 4, 85)
