import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspan.functions import numeric as N
from loomspan.functions import text as S
from loomspan.functions.hashing import u01
from loomspan.operators import curate as C
from loomspan.operators import evaluate as E
from loomspan.operators import gram
from loomspan.operators import ledger as L
from loomspan.operators.store import cover_box


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [
    (None, ""), ("", ""), ("  \n", ""), ("One only", "One only"), ("Ends here.", "Ends here."), ("A b. C d", "A b."),
    ("Hey! You. There", "Hey! You."), ("Hey! You there", "Hey!"), ("a.\nb", "a."), (". leading", ". leading"),
])
def test_first_sentence(spark, text, want):
    assert one(spark, text, S.first_sentence) == want


@pytest.mark.parametrize(("text", "want"), [
    (None, False), ("None.", False), ("There are no obvious visual errors or artifacts.", False), ("The hand has six fingers.", True),
    ("No visible errors. However it shows several artifacts", True),
])
def test_flagged(spark, text, want):
    assert one(spark, text, S.flagged) is want


@pytest.mark.parametrize(("text", "want"), [(None, 0), ("", 0), (" a  b\tc\n", 3)])
def test_word_count(spark, text, want):
    assert one(spark, text, S.word_count) == want


@pytest.mark.parametrize(("url", "want"), [("http://x/000123.jpg", 123), ("http://x/abc.jpg", None), ("http://x/", None), (None, None)])
def test_url_id(spark, url, want):
    assert one(spark, url, S.url_id) == want


@pytest.mark.parametrize(("text", "want"), [('score {"k": 7} x', 7.0), ("no json", None), ('{"k": "bad"}', None), (None, None)])
def test_json_number(spark, text, want):
    assert one(spark, text, lambda c: S.json_number(c, "k")) == want


def test_u01(spark):
    rows = spark.range(2000).select(u01(F.col("id").cast("string")).alias("u")).collect()
    assert all(0 <= r.u < 1 for r in rows) and abs(sum(r.u for r in rows) / 2000 - 0.5) < 0.02


def test_bucket_bounds_and_ties(spark):
    d = spark.createDataFrame([(0.5,), (2.0,), (2.0001,), (0.4999,), (288 / 224,), (320 / 208,)], "a double")
    got = [r.b for r in d.select(C.bucket(F.col("a"), True, F.lit("k"))["bucket"].alias("b")).collect()]
    assert got[2] is None and got[3] is None and None not in got[:2] and {got[4], got[5]} <= {"4_3", "3_2", "1_1"}
    crops = {b: 1 - min(1.2, w / h) / max(1.2, w / h) for b, (w, h) in C.BUCKETS.items()}
    near = min(crops, key=crops.get)
    keys = [r.b for r in spark.range(400).select(C.bucket(F.lit(1.2), True, F.col("id").cast("string"))["bucket"].alias("b")).collect()]
    assert set(keys) == {"1_1", near} and 0.4 < keys.count("1_1") / 400 < 0.6


def test_assemble(spark):
    d = spark.createDataFrame([([" A b. C "], None), (None, ["s ", " "]), ([""], [None]), ([None, "x"], ["y"])], "l array<string>, s array<string>")
    got = [r.r for r in d.select(C.assemble(F.col("l"), F.col("s")).alias("r")).collect()]
    assert got == [Row(long=["A b. C"], short=["A b."]), Row(long=["s"], short=["s"]), None, Row(long=["x"], short=["y"])]


def test_last_wins_and_overwrite(spark):
    d = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b")], "k int, o int, v string")
    assert sorted(map(tuple, C.last_wins(d, ["k"], F.col("o")).collect())) == [(1, 1, None), (2, 0, "b")]
    side = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(map(tuple, C.overwritten(d.where("o = 0"), side, "k", ["v"]).collect())) == [(1, 0, None), (2, 0, "b")]


def test_held_out(spark):
    d = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(2)], "s string, o int").repartition(3)
    got = {(r.s, r.o): r.val for r in C.held_out(d, "s", ["o"], 3).collect()}
    assert {k for k, v in got.items() if v} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)} and len(got) == 9


def test_required(spark):
    with pytest.raises(ValueError, match="missing columns: b, z"):
        C.required(spark.range(1), ["id", "z", "b"])


def pairwise(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auroc_ties_nan_and_empty_side(spark):
    r = random.Random(0)
    rows = [("m", float(r.randint(0, 5)), r.randint(0, 1)) for _ in range(60)] + [("m", float("nan"), 1), ("m", None, 0), ("all", 1.0, 1)]
    got = {x.g: x.auroc for x in E.auroc(spark.createDataFrame(rows, "g string, s double, p int"), "s", "p", ["g"]).collect()}
    wide = [("w", x, k % 2) for k, x in enumerate([float("inf"), 1e300, -1e300, 0.0, 1e-300, float("-inf"), 5.0, float("inf")])]
    got |= {x.g: x.auroc for x in E.auroc(spark.createDataFrame(wide, "g string, s double, p int"), "s", "p", ["g"]).collect()}
    assert got["w"] == pytest.approx(pairwise([x for _, x, p in wide if p], [x for _, x, p in wide if not p]))
    side = lambda k: [s for g, s, p in rows if g == "m" and p == k and s is not None and s == s]
    assert got["m"] == pytest.approx(pairwise(side(1), side(0))) and got["all"] is None


@pytest.mark.parametrize(("n", "c", "k"), [(8, 0, 4), (8, 8, 4), (8, 5, 4), (8, 3, 4), (8, 1, 8), (128, 3, 64)])
def test_pass_at(spark, n, c, k):
    want = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    got = spark.range(1).select(E.pass_at(F.lit(c), F.lit(n), k).alias("p")).first().p
    assert got == pytest.approx(want)


def test_soft_best(spark):
    x = [3.0, 1.0, 2.0, 5.0]
    d = spark.createDataFrame([("a", v) for v in x], "p string, s double")
    s = sorted(x)
    want = sum(s[i] * math.comb(i, 1) / math.comb(4, 2) for i in range(4))
    assert E.soft_best(d, "p", "s", 4, 2).first().soft_best == pytest.approx(want)


def test_advantage_fixture(spark):
    align, style = [0.2, 0.9, 0.5, 0.5, 0.1, 0.1, 0.8, 0.8], [0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(i, i // 4, a, s, float(i == 5)) for i, (a, s) in enumerate(zip(align, style, strict=True))]
    d = spark.createDataFrame(rows, "i int, g int, align double, style double, veto double")
    got = sorted(E.combined_advantage(d, "g", {"align": 1.0, "style": 0.1}, "veto").collect(), key=lambda r: r.i)
    assert sum(r.a_align for r in got[:4]) == pytest.approx(0, abs=1e-9) and got[2].a_style == -0.75
    assert got[5].advantage == min(-2.0, *(r.a_align + 0.1 * r.a_style for r in got[4:]))


def test_group_advantage_has_equal_masses(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(i // 8, r.random()) for i in range(40)], "g int, r double")
    a = [(x.g, x.advantage) for x in E.group_advantage(d, "r", "g").collect()]
    for g in range(5):
        mine = [v for k, v in a if k == g]
        assert sum(mine) == pytest.approx(0, abs=1e-9)
        assert sum(v for v in mine if v > 0) == pytest.approx(-sum(v for v in mine if v < 0))


def test_early_stop_counter(spark):
    values = [10.0, 10.1, 10.2, 10.3, 9.0, 9.2, 9.3, 9.0]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "r string, o int, v double")
    want, best, bad = [], math.inf, 0
    for v in values:
        best = min(best, v)
        bad = bad + 1 if v > best * 1.015 else 0
        want.append((best, bad))
    got = [(r.best, r.bad) for r in L.early_stop(d, "r", "o", "v", 1.015).orderBy("o").collect()]
    assert got == want


def test_even_sample_repeats_short_runs(spark):
    d = spark.createDataFrame([("a", i) for i in range(3)], "r string, o int")
    assert [r.o for r in L.even_sample(d, "r", "o", 5).orderBy("point").collect()] == [0, 0, 1, 2, 2]


def test_schedule_and_box(spark):
    r = spark.range(1).select(N.schedule(4).alias("u"), N.schedule(4, 2.8).alias("s"), cover_box(F.lit(640.0), F.lit(480.0), 256, 256).alias("b")).first()
    assert r.u == [0.0, 0.25, 0.5, 0.75, 1.0] and r.s[0] == pytest.approx(0) and r.s[-1] == pytest.approx(1) and r.s[2] < 0.5
    assert (r.b.w, r.b.h, r.b.left, r.b.top) == (341, 256, 42, 0)


def test_frechet_of_equal_groups(spark):
    r = random.Random(2)
    rows = [(i % 2, [float(x) for x in (r.random(), r.random(), r.random())]) for i in range(60)]
    rows += [(2, v) for k, v in rows if k == 0]
    m = gram.matrices(spark.createDataFrame(rows, "g int, v array<double>"), ["g"], "v")
    of = lambda k: m[k,][1:]
    assert E.frechet(of(0), of(2)) == pytest.approx(0, abs=1e-9) and E.frechet(of(0), of(1)) > 0
