"""Personal data: patterns, and a skip-chain conditional random field that adds spans.

Nodes are the words that may be personal data at all: those with a digit, an at sign or a plus. All other words
have the label O for sure, so they send constant messages and fall out of the graph exactly. Neighbouring words
share chain potentials. Repeated and similar words of a document share skip potentials, wherever they stand: words
(and runs of neighbouring words) that are equal once lower-cased and stripped of separators, that end in the same seven digits,
or that differ in one character of eight or more. Each is linked with the occurrence before it, so edges grow
with the words. Loopy message passing runs over all documents of a batch at once.

The words of pattern spans are observed: their labels are fixed, and the field finds those of all other words. So a
number that stands once as the pattern wants it is also found where it is written otherwise, mistyped in one place,
or run into another number by a greedy match. Added spans never touch a pattern's span.

Training is piecewise, with the pattern spans of at most TRAIN_DOCS documents (by hash) as labels: unary weights by
logistic regression over word shapes, where each word also stands once without the features of its own pattern (HIDDEN), as
words do that patterns miss; pair potentials from how often labels meet on an edge, over prior counts that hold
AGREE times as much for equal labels.

Null and blank texts have no spans. Repeated rows are labelled each by its own text. Very long texts and words are scanned
whole, in linear time. An empty table trains the prior alone and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 20_000
#: Distinct (shape, label) and (edge, labels) rows that training uses at most, the most frequent ones.
TRAIN_ROWS = 65_536
#: Prior count of an edge with equal labels, where one with other labels has 1; the bound of a pair's log potential.
AGREE, BOUND = 60.0, 4.0
CAUTION = 1.5
ROUNDS, DAMPING, SURE = 8, 0.5, 0.9
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@+]")
_REST = re.compile(r"[0-9@+][^\x20\x09-\x0D]*")
_WHITE = " \t\n\x0b\x0c\r"
_TRIM = "\"'.,;:!?()[]{}<>"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern spans in order of kind, then start. The patterns are fixed values."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((0, start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


_QUAD, _PAIR, _NUMBER = re.compile(r"[0-9]+(\.[0-9]+){3}$"), re.compile(r"[0-9]+(\.[0-9]+){1,2}$"), re.compile(r"[0-9]+$")
_PLUS, _BRACKETS, _DASHED, _LEAD = re.compile(r"\+[0-9]"), re.compile(r"\([0-9]+\)$"), re.compile(r"[0-9]+-[0-9-]+[0-9]$"), re.compile(r"[0-9][0-9-]*$")
_ALPHA, _ASSIGN, _KEY, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[=\"']"), re.compile(r"[^0-9a-z@]"), re.compile(r"[^0-9]")
SHAPES = (
    lambda w: "." in w[w.find("@") :] if "@" in w else False, lambda w: "@" in w, _QUAD.match, _PAIR.match, _NUMBER.match,
    _PLUS.match, _BRACKETS.match, _DASHED.match, _ALPHA.search, _ASSIGN.search, _LEAD.match,
)
#: Digit counts from which the next class starts.
DIGITS = (1, 3, 5, 8, 13, 16, 20)
_LUHN = 1 << (1 + len(SHAPES) + len(DIGITS))
_AFTER_PLUS, _AFTER_BRACKETS, _BEFORE_BRACKETS = _LUHN << 1, _LUHN << 2, _LUHN << 3
FEATURES = 1 + len(SHAPES) + len(DIGITS) + 4
#: What a word keeps where its own pattern is hidden: the constant, the classes of digit counts, letters, signs and neighbours.
HIDDEN = 1 | sum(1 << (1 + len(SHAPES) + k) for k in range(len(DIGITS))) | 2 << 8 | 2 << 9 | _AFTER_PLUS | _AFTER_BRACKETS | _BEFORE_BRACKETS
CHAIN, SAME, SIMILAR = 0, 1, 2
#: Characters that a similar word has at least, and digits at the end that make numbers one.
SIMILAR_LENGTH, TAIL = 8, 7


def candidates(text: str):
    """(start, end) of the words with a digit, an at sign or a plus, in time linear in the text however long its words are."""
    done = 0
    for m in _REST.finditer(text):
        # What lies between two such words is searched backwards once for each kind of white space.
        start = 1 + max(text.rfind(c, done, m.start()) for c in _WHITE)
        done = m.end()
        yield start, done


def _own(word: str) -> int:
    mask = 1
    for k, shape in enumerate(SHAPES):
        if shape(word):
            mask |= 2 << k
    digits = _DIGIT.sub("", word)
    n = sum(len(digits) >= d for d in DIGITS)
    if n:
        mask |= 1 << (len(SHAPES) + n)
    if 13 <= len(digits) <= 19 and luhn(digits):
        mask |= _LUHN
    return mask


def _held(key: str) -> str | bytes:
    """A key of bounded size: long ones by their hash."""
    return key if len(key) <= 64 else hashlib.blake2b(key.encode(), digest_size=16).digest()


def one_off(a: str, b: str) -> bool:
    """Whether two words of one length differ in one character."""
    half = 0
    while len(a) - half > 64:  # equal halves are passed over as a whole
        step = (len(a) - half) // 2
        if a[half : half + step] != b[half : half + step]:
            return a[half + step :] == b[half + step :] and one_off(a[half : half + step], b[half : half + step])
        half += step
    return sum(x != y for x, y in zip(a[half:], b[half:], strict=True)) == 1


class Nodes:
    """Words of one text that may be personal data: places, feature masks and edges (i, j, kind)."""

    def __init__(self, text: str):
        self.spans, self.masks, self.edges = [], [], []
        self.keys: dict = {}
        self.chain: set[tuple[int, int]] = set()
        end, run = -2, []  # run: neighbouring words of digits and signs
        for start, stop in candidates(text):
            word = text[start:stop]
            lead = len(word) - len(word.lstrip("\"'[{<"))
            body = word[lead:].rstrip("\"'.,;:!?]}>")
            i = len(self.spans)
            self.spans.append((start + lead, start + lead + len(body)))
            mask = _own(body)
            linked = end >= 0 and start - end <= 2 and text[end:start].isspace()
            if linked:
                self.chain.add((i - 1, i))
                self.edges.append((i - 1, i, CHAIN))
                if self.masks[-1] & 64:  # a plus and a digit before
                    mask |= _AFTER_PLUS
                if self.masks[-1] & 128:  # digits in brackets before
                    mask |= _AFTER_BRACKETS
                if mask & 128:
                    self.masks[-1] |= _BEFORE_BRACKETS
            self.masks.append(mask)
            key = _KEY.sub("", body.lower())
            plain = not _ALPHA.search(body) and "@" not in body
            if not (linked and plain and run):
                self._close(run)
                run = []
            if plain:
                run.append((i, key))
            self._link(i, i, key, plain)
            end = stop
        self._close(run)
        del self.keys

    def _close(self, run: list[tuple[int, str]]) -> None:
        """Links the words of a run with what holds all its digits."""
        if len(run) > 1:
            self._link(run[0][0], run[-1][0], "".join(k for _, k in run), True)

    def _link(self, first: int, last: int, key: str, plain: bool) -> None:
        """Skip edges from each of the words first..last to the words that had a like key before."""
        if len(key) < 4:
            return
        found = [((SAME, _held(key)), SAME)]
        if plain and len(key) >= TAIL:
            found.append(((SAME, "tail", key[-TAIL:]), SAME))
        if len(key) >= SIMILAR_LENGTH:
            half = len(key) // 2
            found += [((SIMILAR, len(key), k, _held(part)), SIMILAR) for k, part in enumerate((key[:half], key[half:]))]
        linked: set[int] = set()
        for at, kind in found:
            old = self.keys.get(at)
            if old is not None and old[1] < first and old[0] not in linked and (kind == SAME or one_off(old[2], key)):
                linked.add(old[0])
                # Words of the longer side each share a potential with the other side's words in turn.
                n = max(last - first, old[1] - old[0]) + 1
                pairs = {(min(old[0] + k, old[1]), min(first + k, last)) for k in range(n)}
                self.edges += [(i, j, kind) for i, j in sorted(pairs) if (i, j) not in self.chain]
            self.keys[at] = (first, last, key)

    def labels(self, found: list[Span]) -> list[int]:
        """1 + kind of the pattern span that a word lies in, else 0."""
        out = [0] * len(self.spans)
        ordered = sorted((a, b, k) for k, a, b in found)
        j = 0
        for i, (a, b) in enumerate(self.spans):
            while j < len(ordered) and ordered[j][1] <= a:
                j += 1
            if j < len(ordered) and ordered[j][0] < b:
                out[i] = 1 + ordered[j][2]
        return out


def _bits(masks) -> np.ndarray:
    return ((np.asarray(masks, np.int64)[:, None] >> np.arange(FEATURES)) & 1).astype(float)


class Field:
    """Unary weights (features x labels) and log potentials of chain, same-word and similar-word edges.

    known: shapes that training saw under each label. A label under which a shape was never seen scores CAUTION less than
    O at most, so that a shape alone never gives it: the words around or like it have to.
    """

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, known: list[np.ndarray] | None = None):
        self.weights, self.pairs, self.known = weights, pairs, known

    def unary(self, masks: list[int]) -> np.ndarray:
        out = _bits(masks) @ self.weights
        for label, shapes in enumerate(self.known or ()):
            if label:
                new = ~np.isin(masks, shapes)
                out[new, label] = np.minimum(out[new, label], out[new, 0] - CAUTION)
        return out

    def marginals(self, masks: list[int], edges: np.ndarray, kinds: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of all nodes after ROUNDS of damped sum-product messages; seen: labels that are known, else -1."""
        unary = self.unary(masks)
        if seen is not None and (known := np.flatnonzero(seen >= 0)).size:
            unary[known] = -50.0
            unary[known, seen[known]] = 0.0
        belief = unary.copy()
        if len(edges):
            a, b = edges[:, 0], edges[:, 1]
            psi = self.pairs[kinds]
            ab, ba = np.zeros((len(a), unary.shape[1])), np.zeros((len(a), unary.shape[1]))
            for _ in range(ROUNDS):
                new = []
                for source, back, table in ((a, ba, psi), (b, ab, psi.transpose(0, 2, 1))):
                    x = (belief[source] - back)[:, :, None] + table
                    top = x.max(axis=1)
                    m = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
                    new.append(m - m.max(axis=1, keepdims=True))
                ab, ba = DAMPING * ab + (1 - DAMPING) * new[0], DAMPING * ba + (1 - DAMPING) * new[1]
                belief = unary.copy()
                np.add.at(belief, b, ab)
                np.add.at(belief, a, ba)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(masks: list[int], labels: list[int], counts: list[int], meets: dict[tuple[int, int, int], int], rounds: int = 400) -> Field:
    """Piecewise training from counted (mask, label) and (edge kind, label, label)."""
    n = len(KINDS) + 1
    w = np.zeros((FEATURES, n))
    if masks:
        x, c, y = np.concatenate([_bits(masks), _bits([m & HIDDEN for m in masks])]), np.array([*counts, *counts], float), np.eye(n)[[*labels, *labels]]
        c /= c.sum()
        c = np.sqrt(c)  # frequent shapes count less than their share
        c /= c.sum()
        for t in range(rounds):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w -= 4.0 * (x.T @ (c[:, None] * (p - y)) + 1e-4 * w)
    pairs = np.zeros((3, n, n))
    for k in (CHAIN, SAME, SIMILAR):
        joint = np.full((n, n), 1.0) + (0 if k == CHAIN else (AGREE - 1) * np.eye(n))
        for (kind, i, j), m in meets.items():
            if kind == k:
                joint[i, j] += m
                if k != CHAIN:
                    joint[j, i] += m
        joint /= joint.sum()
        pairs[k] = np.clip(np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))), -BOUND, BOUND)
    return Field(w, pairs, [np.array(sorted({m for m, l in zip(masks, labels, strict=True) if l == k}), np.int64) for k in range(n)])


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> Field:
    """The field from the pattern spans of at most `bound` documents; only counts of shapes come to the driver."""
    sample = common.sampled(docs, bound).select("text")

    def count(batches):
        for rb in batches:
            rows = []
            for text in rb.column(0).to_pylist():
                if text and _MAYBE.search(text):
                    nodes = Nodes(text)
                    y = nodes.labels(base_spans(text))
                    rows += [(0, m, l, 0) for m, l in zip(nodes.masks, y, strict=True)]
                    rows += [(1 + k, 0, y[i], y[j]) for i, j, k in nodes.edges]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["what", "mask", "a", "b"])

    got = sample.mapInArrow(count, "what long, mask long, a long, b long").groupBy("what", "mask", "a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "what", "mask", "a", "b").limit(TRAIN_ROWS).collect()
    shapes = sorted((r.mask, r.a, r.n) for r in got if r.what == 0)
    return fit([s[0] for s in shapes], [s[1] for s in shapes], [s[2] for s in shapes], {(r.what - 1, r.a, r.b): r.n for r in got if r.what})


def added(field: Field, texts: list[str], base: list[list[Span]], skip: bool = True) -> list[list[Span]]:
    """Spans that the field adds to each text: runs of words with one sure label that touch no pattern span.

    skip: without it, only chain edges count (to measure what skip edges do).
    """
    graphs = [Nodes(t) for t in texts]
    first = np.cumsum([0, *[len(g.spans) for g in graphs]])
    masks = [m for g in graphs for m in g.masks]
    out: list[list[Span]] = [[] for _ in texts]
    if not masks:
        return out
    e = np.array([(i + f, j + f, k) for g, f in zip(graphs, first, strict=False) for i, j, k in g.edges if skip or k == CHAIN], np.int64).reshape(-1, 3)
    held = [g.labels(b) for g, b in zip(graphs, base, strict=True)]
    seen = np.array([k or -1 for h in held for k in h], np.int64)
    p = field.marginals(masks, e[:, :2], e[:, 2], seen)
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0).tolist()
    for t, (g, f) in enumerate(zip(graphs, first, strict=False)):
        own = label[f : f + len(g.spans)]
        if any(own):
            run = None
            for i, k in enumerate(own):
                if not k or held[t][i] or g.spans[i][0] >= g.spans[i][1]:
                    run = None
                elif run is not None and run == k and (i - 1, i) in g.chain:
                    out[t][-1] = (k - 1, out[t][-1][1], g.spans[i][1])
                else:
                    out[t].append((k - 1, *g.spans[i]))
                    run = k
    return out


def spans_of(field: Field, texts: list[str], skip: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans in order of kind, then start) of each text."""
    base: list[list[Span]] = [[] for _ in texts]
    active = [i for i, t in enumerate(texts) if t and _MAYBE.search(t)]
    for i in active:
        base[i] = base_spans(texts[i])
    more = dict(zip(active, added(field, [texts[i] for i in active], [base[i] for i in active], skip), strict=True))
    return [(b, sorted(b + more.get(i, []))) for i, b in enumerate(base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        for rb in batches:
            found = spans_of(field, [t or "" for t in rb.column(1).to_pylist()])
            counts = [[sum(k == s[0] for s in b) for b, _ in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(a) for _, a in found]), pa.array([len(a) - len(b) for b, a in found], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are one, named by the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the spans in `text` masked and `n_chars`, where there is one, counted anew; other columns stay."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for rb in batches:
            at = rb.schema.names.index("text")
            texts = rb.column(at).to_pylist()
            new = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, spans_of(field, [t or "" for t in texts]), strict=True)]
            columns = list(rb.columns)
            columns[at] = pa.array(new, rb.column(at).type)
            if "n_chars" in names:
                k = rb.schema.names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in new], rb.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=rb.schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs))
