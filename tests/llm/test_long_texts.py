"""Texts of megabytes beside short ones, through every operator on texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspan.llm import common, jaccard, lm_score, mixing, packing, pii_crf, quality, suffix_dedup, token_files
from loomspan.llm.tokenize import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(1, 9))) for _ in range(40_000)]
    text = " ".join(r.choice(words) for _ in range(450_000))
    other = text[:1_000_000] + " mail x1@a.org or 10.0.0.1 " + " ".join(r.choice(words) for _ in range(200_000))
    rows = [(1, text, "a"), (2, "short one", "a"), (3, other, "b"), (4, None, None), (5, text, "b"), (6, "y" * 1_500_000, "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def test_repeated_strings(long):
    rows, docs = long
    keyed, found = suffix_dedup.ranges(docs)
    got = {r.doc_id: r for r in suffix_dedup.cut(keyed, found).collect()}
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    assert {i: r.n_bytes for i, r in got.items()} == size
    assert got[1].n_removed == size[1] == got[5].n_removed and got[6].n_removed == size[6] and got[2].n_removed == 0
    shared = len(rows[0][1][:1_000_000].encode())
    assert shared <= got[3].n_removed <= shared + 2 and got[3].n_spans == 1  # the next byte is a space in one, and may be in the other
    assert got[3].kept_sha256 == hashlib.sha256(rows[2][1].encode()[got[3].n_removed :]).hexdigest()


def test_personal_data(long):
    rows, docs = long
    for r in pii_crf.find(docs, pii_crf.train(docs)).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 0, 0) if r.doc_id == 3 else (0, 0, 0, 0))


def test_tokens_and_packing(spark, long):
    rows, docs = long
    where = common.shared_dir(spark)
    got = {r.doc_id: r for r in token_files.read_files(spark, where, token_files.write_files(docs, where, default_path("byte_bpe_50k.json"), "byte_bpe", 0)).collect()}
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    at = 0
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    pieces = packing.pack(packing.pieces(docs, default_path("word_bpe_49k.json"), "word_bpe", 1), 1).collect()
    for i, t, _ in rows[:4]:
        assert sum(p.length for p in pieces if p.doc_id == i) == len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert len({p.sequence_id for p in pieces}) <= -(-sum(p.length for p in pieces) // 4096) + 1


def test_links_words_and_mix(spark, long):
    rows, docs = long
    words = {i: WORD.findall((t or "").lower()) for i, t, _ in rows}
    for r in jaccard.link(docs, 4, 85).collect():
        w = words[r.doc_id]
        assert r.n_shingles == (len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if len(w) > 3 else bool(w))
        assert r.component_id == (1 if r.doc_id == 5 else r.doc_id)
    scored = lm_score.score(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), 1 << 20).collect()
    assert {r.doc_id: r.n_words for r in scored} == {i: len(w) for i, w in words.items()}
    placed, mixed = mixing.shards(docs)
    taken = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert {r.doc_id: r["size"] for r in placed.collect()} == {i: len(w) for i, w in words.items()} and set(taken) <= {1, 2, 3, 5, 6}


def test_quality(long):
    rows, docs = long
    got = {r.doc_id: r for r in common.written(quality.judged(docs.select("doc_id", "text"), []).select("doc_id", "n_words", "word_chars", "kept")).collect()}
    assert all(got[i].n_words == len(WORD.findall(t or "")) and got[i].word_chars == sum(map(len, WORD.findall(t or ""))) for i, t, _ in rows)
