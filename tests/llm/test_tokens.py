import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import common, packing, simple8b, token_files
from loomspan.llm.tokenize import Ids, default_path

FILES = {"byte_bpe": "byte_bpe_50k.json", "word_bpe": "word_bpe_49k.json"}


@pytest.mark.parametrize("kind", list(FILES))
def test_chunked_ids_equal_the_librarys(kind):
    r = random.Random(3)
    alpha = list(" \t\n\x1c\x85\xa0　aAbéß'.,!?01_-@£́漢字ΣσİIıǅ½²٣😀|<>\r\x0b×÷'sl")
    texts = ["".join(r.choices(alpha, k=r.randint(0, 40))) for _ in range(3000)] + ["don't I'll", "<|endoftext|> x", ""]
    specials = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "ab", " ", "\n", "é"]
    texts += ["".join(r.choices([*alpha, *specials * 3], k=r.randint(1, 12))) for _ in range(3000)]
    coder, library = Ids(default_path(FILES[kind]), kind), Tokenizer.from_file(default_path(FILES[kind]))
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("kind", list(FILES))
def test_added_tokens_are_ids_of_their_own(kind):
    untouched = Tokenizer.from_file(default_path(FILES[kind]))
    added = [x.content for x in untouched.get_added_tokens_decoder().values()]
    texts = [f"a {x} b{x}{x}\u3000c {x.upper()}" for x in added] + ["a <|endoftext|> x", "plain", "", "last <|endoftext|>"]
    for text, ids in zip(texts, Ids(default_path(FILES[kind]), kind).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == untouched.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 20, 1 << 32])
def test_simple8b_round_trip(n, high):
    x = np.random.default_rng(n + high).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    x[n // 3 : n // 2] = 0
    assert (simple8b.decode(*simple8b.encode(x), n) == x).all()


def test_token_files(spark, odd):
    where = common.shared_dir(spark)
    got = token_files.read_files(spark, where, token_files.write_files(odd, where, default_path(FILES["byte_bpe"]), "byte_bpe", 0)).collect()
    library, at = Tokenizer.from_file(default_path(FILES["byte_bpe"])), 0
    want, order = [], sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in order:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_token_files_of_nothing(spark, none):
    where = common.shared_dir(spark)
    assert token_files.read_files(spark, where, token_files.write_files(none, where, default_path(FILES["byte_bpe"]), "byte_bpe", 0)).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


@pytest.mark.parametrize(("open_bins", "ahead"), [(2, 1), (64, 7), (64, 1 << 14)])
def test_packing(spark, odd, open_bins, ahead):
    found = packing.pieces(odd, default_path(FILES["word_bpe"]), "word_bpe", 1, 512)
    rows = packing.pack(found, 2, 512, open_bins, ahead).collect()
    library = Tokenizer.from_file(default_path(FILES["word_bpe"]))
    want = []
    for r in odd.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, want))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512


def test_packing_nothing(none):
    assert packing.pack(packing.pieces(none, default_path(FILES["word_bpe"]), "word_bpe", 1), packing.packers_for(none)).count() == 0


def test_few_sequences(spark):
    """Many more pieces than open bins hold: nearly as few sequences as their tokens fill."""
    r = random.Random(8)
    lengths = [min(4096, int(r.lognormvariate(5.5, 1.3)) + 1) for _ in range(60_000)]
    found = spark.createDataFrame([(i, 0, 0, n, i * 7) for i, n in enumerate(lengths)], packing.PIECE)
    used = packing.pack(found, 1, open_bins=256).select("sequence_id").distinct().count()
    assert used <= 1.005 * -(-sum(lengths) // 4096)


def test_many_files_are_read_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_TASKS", 300)
    manifest = spark.range(0, 1_000_000, 1, 4).selectExpr("cast(id as int) as part", "'x' as path", "id as n_docs", "cast(2 as long) as n_ids")
    plan = token_files.planned(manifest)
    sizes = plan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("base") - 2 * F.col("number"))).alias("off")).collect()
    assert len(sizes) == 300 and max(x.n for x in sizes) == 3334 and all(x.off == 0 for x in sizes)
