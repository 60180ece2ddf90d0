import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import common, jaccard, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def cut(df, **kw):
    keyed, found = suffix_dedup.ranges(df, **kw)
    return sorted(str(tuple(r)[:5]) for r in suffix_dedup.cut(keyed, found, kw.get("length", 200)).collect())


@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    doc = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    common, line, rows = [doc(r.randint(30, 400)) for _ in range(8)], "A common licence line that stands everywhere. " * 4, []
    for i in range(90):
        t = doc(r.randint(0, 300)) + "".join(r.choice(common) + doc(r.choice([0, 1, 60])) for _ in range(r.randint(0, 4)))
        rows.append((i, t[:50] + line + t[50:] if r.random() < 0.5 else t))
    return [*rows, (200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 700), (204, rows[3][1]), (205, rows[3][1]), (205, rows[3][1])]


@pytest.mark.parametrize("kw", [{"length": 60, "gram": 12}, {"length": 60, "gram": 12, "hot": 4}, {"length": 200, "gram": 40, "rows_held": 10}, {"length": 60, "gram": 60}])
def test_repeated_strings(spark, passages, kw):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(4)
    assert cut(df, **kw) == removed(passages, kw["length"])


def test_long_texts_are_sampled_by_pieces(spark, passages, monkeypatch):
    # The pieces' size is read on executors; the function itself is checked for covering each string once.
    import numpy as np

    for size in (1, 7, 500):
        some = suffix_dedup.pieces(np.array([0, 40, 45, 45, 1000]), 20, size)
        starts = [p for b in some for _, lo, hi in b for p in range(lo, hi - 19)]
        assert sorted(starts) == [*range(0, 21), *range(45, 981)]


def test_repeated_strings_odd(odd, none):
    assert cut(odd, length=60, gram=12) == removed([(r.doc_id, r.text) for r in odd.collect()], 60)
    assert cut(none) == []


def linked(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(str((d, len(sets[i]), least.get(root(i)))) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def similar():
    r, rows = random.Random(3), []
    for _ in range(40):
        n = r.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 20, 40, 80, 300])
        base = [f"w{r.randint(0, 3000)}" for _ in range(n)]
        for _ in range(r.choice([1, 2, 3, 8, 30])):
            w = base[:]
            for _ in range(r.randint(0, max(1, n // 15))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows), r.choice([" ", "  ", "\n"]).join(w + ["c1 c2 c3 c4 c5 c6 c7"] * (r.random() < 0.3))))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("tokens", [3_000_000, 300])
def test_components(spark, similar, k, percent, tokens):
    df = spark.createDataFrame(similar, "doc_id long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in jaccard.link(df, k, percent, tokens).collect()) == linked(similar, k, percent)


def test_components_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in jaccard.link(odd, 4, 85).collect()) == linked(rows, 4, 85)
    assert jaccard.link(none, 4, 85).count() == 0


@pytest.mark.parametrize("tokens", [3_000_000, 300])
def test_different_texts_of_one_id_and_null_ids_keep_their_links(spark, tokens):
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    near = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    rows = [(1, near()), (1, near(10, 40, 70)), (2, near(0)), (None, near(119)), (5, near(118, 0)), (None, "only null " * 9), (None, "only null " * 9), (None, near(3) + " y")]
    rows += [(7, " ".join(f"v{r.randint(0, 99)}" for _ in range(50))) for _ in range(30)]
    rows += [(8, "the same text again and again")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(x)) for x in jaccard.link(df, 4, 85, tokens).collect()) == linked(rows, 4, 85)


def test_hot_keys_join_like_others(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    right = spark.createDataFrame([(7, "a"), (8, "b")], "k long, v string")
    want = sorted((r.id, 7 if r.id % 3 == 0 else r.id, {7: "a", 8: "b"}.get(7 if r.id % 3 == 0 else r.id)) for r in left.collect())
    for least in (10, 100_000):
        assert sorted((r.id, r.k, r.v) for r in common.hot_join(left, right, ["k"], least).collect()) == want


def test_linked_sizes_are_in_neighbouring_classes():
    known = jaccard.classes(85, 4000)
    of = lambda n: max(i for i, c in enumerate(known) if c[0] <= n)
    assert all(of(100 * n // 85) - of(n) <= 1 for n in range(1, 3000))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_nested_sets_share_a_signature(percent):
    """Every linked pair becomes a candidate, also where most shingles are frequent and the sizes straddle a multiple of the segments."""
    r = np.random.default_rng(9)
    for small, large in [(30, 35), (40, 47), (68, 75), (90, 100), (170, 200)]:
        if 100 * small < percent * large:
            continue
        for _ in range(1500):
            tokens = r.integers(0, 1 << 64, large, dtype=np.uint64)
            signer = jaccard.Signer(percent, np.sort(r.permutation(tokens)[: large * 7 // 10]))
            a, b = signer.sign(np.sort(tokens[:small])), signer.sign(np.sort(tokens))
            assert len(np.intersect1d(a, b)), (small, large)


def test_signatures_travel_in_twelve_bytes(spark):
    """Sixteen before: signatures are most of what the stage shuffles. Cut ones still find every link."""
    from loomspan.llm import jaccard

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 40 : i % 40 + 60] + ([f"x{i}"] if i >= 40 else []))) for i in range(80)]
    out = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    roots = {r.doc_id: r.component_id for r in out}
    assert jaccard.SIGN.itemsize == 12 and all(roots[i] == roots[i + 40] for i in range(40)) and set(roots.values()) == {0}
