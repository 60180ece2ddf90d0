import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, key string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, blank, repeated, tied and long rows, with extra columns whose names clash."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9)))
    texts = [None, "", " \n\t ", "one", "one", "One", "a b c", "é 漢字 😀 '\x1c. mail a@b.co", " ".join(word() for _ in range(6000))]
    base = [word() for _ in range(80)]
    for k in range(6):
        t = base[:]
        t[r.randrange(80)] = f"x{k}"
        texts.append(" ".join(t))
    texts += [texts[-1], "line here again\n" * 30, "z" * 1500, "call +1 (555) 123-4567 or 10.0.0.1 4539578763621486"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "x", "k", 2) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "null id here " * 5, "en", "s1", 10, 1, "x", "k", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
