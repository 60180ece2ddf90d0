import hashlib
import random

import numpy as np
import pytest

from loomspan.llm import common, line_dedup

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept text) of each (doc_id, text)."""
    rank = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(WHITE).translate(FOLD)
            if len(key) >= 10:
                least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if least.get(x.strip(WHITE).translate(FOLD), rank(i)) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.cut(docs).collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert line_dedup.cut(none).count() == 0
    clash = odd.selectExpr("*", "'x' as keep", "7 as n_dropped", "1 as n_lines", "'y' as t1", "1 as h1", "2 as pos")
    assert found(clash) == brute(rows)


@pytest.mark.parametrize("parts", [1, 13, 60])
def test_runs_over_borders(spark, monkeypatch, parts):
    """Hot lines span whole ranges; ids repeat, are null or negative; lines repeat inside a document."""
    r = random.Random(parts)
    pool = [f"  Line number {k} of the pool\t" for k in range(8)] + ["SHORT", "", "ünïcode line ÄÖÜ", "line NUMBER 0 of the pool"]
    rows = [(r.choice([None, None, -5, *range(300)]), "\n".join(r.choice(pool[:1] * 8 + pool + [f"own line {k} {r.random()}"]) for _ in range(r.randint(0, 9)))) for k in range(900)]
    rows += rows[:40] + [(None, None), (3, "")]
    monkeypatch.setattr(common, "parts_for", lambda df, mb: parts)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_line_in_every_document_is_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "parts_for", lambda df, mb: 20)
    docs = spark.range(4000).selectExpr("id as doc_id", "'the very same line' as text")
    sizes = [n for n in line_dedup.hashes(docs).repartitionByRange(20, "h1", "h2", "doc_id", "t1", "t2", "pos").rdd.glom().map(len).collect()]
    assert max(sizes) < 1000
    got = {r.doc_id: r.n_dropped for r in line_dedup.cut(docs).collect()}
    assert got == {i: int(i > 0) for i in range(4000)}


def test_bitmaps_round_trip():
    r = random.Random(4)
    for _ in range(300):
        n = r.choice([1, 5, 200, 40_000])
        gone = np.array(sorted(r.choices(range(n), k=r.randint(0, n))), np.int64)
        keep = np.ones(n, bool)
        keep[gone] = False
        assert (line_dedup.decode(line_dedup.encode(gone), n) == keep).all()
    assert len(line_dedup.encode(np.arange(1_000_000))) == 4  # a run is a number, not a bit a line


def test_long_texts(spark):
    long = "\n".join(f"line number {k % 50_000}" for k in range(120_000)) + "\n" + "y" * 1_500_000
    rows = [(1, "line number 7"), (2, long), (3, long), (4, "y" * 1_500_000)]
    got = {r.doc_id: r for r in line_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (n, d, k) for i, n, d, k in brute(rows)}
    assert {i: (x.n_lines, x.n_dropped) for i, x in got.items()} == {i: w[:2] for i, w in want.items()}
    assert all(hashlib.sha256(got[i].kept.encode()).digest() == hashlib.sha256(w[2].encode()).digest() for i, w in want.items())
