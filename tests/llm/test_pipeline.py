import random

import corpus_pipeline
from loomspan.llm import common, mixing


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
        if name == "best_fit_packing":
            assert docs.columns[:2] == ["doc_id", "piece"] and docs.count() >= before
            break
        assert docs.columns == columns
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows) <= before
        assert all(r.n_chars == len(r.text) for r in rows)
        if name in ("quality_rules", "near_duplicates"):
            assert all(texts[r.doc_id] == r.text for r in rows)
        before = len(rows)


def test_stages_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    assert docs.columns[0] == "doc_id"


def test_stages_on_nothing(spark, none, sf_dir):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def planted(spark):
    """(documents, labels) of clean prose, junk, copies, near copies and personal data."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghilmnorstuvw") for _ in range(r.randint(2, 9)))
    vocabulary = [word() for _ in range(3000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, labels, group = [], [], {}
    for i in range(160):
        rows.append((i, " ".join(prose(r.randint(80, 400))), "clean"))
        labels.append((i, 1, 0))
    for i in range(200, 260):
        rows.append((i, " ".join(w + "###" for w in prose(90)), "junk"))
        labels.append((i, 0, 0))
    for i in range(300, 310):
        rows.append((i, "short text", "short"))
    for i in range(20):
        words = rows[i][1].split()
        rows.append((400 + i, rows[i][1], "copy"))
        words[len(words) // 2] = "changed"
        rows.append((500 + i, " ".join(words), "near"))
        group |= {400 + i: i, 500 + i: i}
    for i in range(600, 620):
        text = prose(100)
        text[50] = f"user{i}@mail.example.com"
        text[60] = f"10.0.{i - 600}.7"
        text[70] = f"+1 (555) 123-{4000 + i}"
        rows.append((i, " ".join(text), "private"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: k for i, _, k in rows}, group


def test_decisions_on_planted_documents(spark, tmp_path):
    docs, labels, kinds, group = planted(spark)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf_dir = common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir))
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        if name == "quality_rules":
            assert ids == {i for i, k in kinds.items() if k not in ("junk", "short")}
        elif name == "near_duplicates":
            assert not ids & set(group) and ids == {i for i, k in kinds.items() if k in ("clean", "private")}
        elif name == "personal_data":
            old = {r.doc_id: r.text for r in before.collect()}
            for r in rows:
                if kinds[r.doc_id] == "clean":
                    assert r.text == old[r.doc_id]
                else:
                    assert "@" not in r.text and "555" not in r.text and "10.0." not in r.text and {"<EMAIL>", "<IP>", "<PHONE>"} <= set(r.text.split())
        elif name == "source_mix":
            sizes = {r.doc_id: len(r.text.split()) for r in before.collect()}
            source = {r.doc_id: r.source for r in before.collect()}
            words = lambda of, s: sum(n for i, n in of.items() if source[i] == s)
            names = sorted(set(source.values()))
            want = mixing.targets([words(sizes, s) for s in names], [5.0, 2.0, 1.0])
            taken = {r.doc_id: len(r.text.split()) for r in rows}
            assert all(taken[i] <= 2 * sizes[i] for i in taken)
            assert all(abs(words(taken, s) - w) <= 2 * mixing.BLOCK for s, w in zip(names, want, strict=True))
        else:
            held = {}
            for r in rows:
                held.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in held.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= 4096
            total = sum(r.length for r in rows)
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()} and len(held) <= -(-total // 4096) + 1


def test_mix_of_repeated_and_null_ids(spark):
    """Each row has the words that the shards hold of it, and never more than two passes over its text."""
    text = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    rows = [(1, text(1000, "a"), "x"), (1, text(100, "b"), "x"), (None, text(300, "c"), "x"), (None, text(300, "d"), "y"), (None, text(40, "e"), "y"), (2, None, "y"), (None, text(40, "e"), "y")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = common.written(docs.repartition(3))
    out = corpus_pipeline.source_mix(spark, docs, "").collect()
    _, mixed = mixing.shards(docs)
    assert sum(len(r.text.split()) for r in out) == sum(r.upto - r["first"] for r in mixed.collect())
    size = {"a": 1000, "b": 100, "c": 300, "d": 300, "e": 40}
    for r in out:
        letters = {w[0] for w in r.text.split()}
        assert len(letters) == 1 and len(r.text.split()) <= 2 * size[letters.pop()]
    assert sum("e0" in r.text.split() for r in out) <= 2 and all(r.doc_id == 1 for r in out if r.text[0] in "ab")


def test_near_duplicates_leave_texts_in_their_tasks(spark, tmp_path):
    """Texts of all documents were shuffled twice at the end of the stage; rows that stay are named beside them now."""
    words = [f"w{i}" for i in range(300)]
    near = [(i, " ".join([*words[i % 20 : i % 20 + 60], *([f"x{i}"] if i >= 20 else [])])) for i in range(60)]
    rows = [*near, (1, near[1][1]), (1, "another text with the id"), (None, near[2][1]), (None, "alone"), (None, "alone"), (7, ""), (7, ""), (8, None), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.schema == docs.schema
    want = [near[0], (1, "another text with the id"), (None, "alone"), (7, ""), (8, None)]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))


def test_rows_beside_others(spark, tmp_path, monkeypatch):
    """Parts of few rows, files without any, and other columns than numbers."""
    monkeypatch.setattr(common, "LOOKUP_ROWS", 7)
    spark.range(100).selectExpr("id", "concat('t', id) AS text").repartition(4).write.parquet(f"{tmp_path}/t")
    docs = common.row_keyed(spark.read.parquet(f"{tmp_path}/t"))
    small = docs.where("id % 3 = 0 and id < 60").selectExpr("_file", "_row", "id * 2 AS twice", "if(id % 2 = 0, text, null) AS name")
    out = common.beside_rows(docs, small, 100).collect()
    assert sorted((r.id, r.text, r.twice, r.name) for r in out if r.name) == [(i, f"t{i}", 2 * i, f"t{i}") for i in range(0, 60, 6)]
    assert sorted(r.id for r in out) == list(range(0, 60, 3)) and all(r.twice == 2 * r.id for r in out)
    assert common.beside_rows(docs, small.where("twice < 0"), 100).collect() == []
