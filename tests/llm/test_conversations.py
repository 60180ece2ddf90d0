import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomspan.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
VALID = re.compile(r"(s?(ua)+)?")


def cheapest(kinds, gap=1):
    """(cost, audit, edits) by trying everything: kinds are (initial, must go, truncated)."""
    best = None
    inserts = [x for n in range(gap + 1) for x in itertools.product("ua", repeat=n)]
    edits = [[("D", "", 4)] + ([] if must else [("K", i, 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)]) for i, must, cut in kinds]
    for chosen in itertools.product(*edits):
        for put in itertools.product(inserts, repeat=len(kinds) + 1):
            roles, audit, cost = "".join(put[0]), "I" * len(put[0]), 3 * sum(map(len, put))
            for (e, r, c), more in zip(chosen, put[1:], strict=True):
                roles, audit, cost = roles + r + "".join(more), audit + e + "I" * len(more), cost + c
            if VALID.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def code(kind):
    i, must, cut = kind
    return {"s": cv.S, "u": cv.U, "a": cv.A}.get(i, cv.OTHER) | (cv.MUST if must else 0) | (cv.CUT if cut else 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_against_all_edits(seed):
    import numpy as np

    r = random.Random(seed)
    every = [(i, m, c and not m) for i in "suat" for m in (False, True) for c in (False, True)]
    groups = [list(x) for n in (0, 1, 2) for x in itertools.product(every[:: 1 if n < 2 else 3], repeat=n)]
    groups += [[r.choice(every) for _ in range(3)] for _ in range(60)]
    codes = np.array([code(k) for g in groups for k in g], np.int64)
    cost, audits = cv.solve(codes, np.array([len(g) for g in groups]))
    for g, c, a in zip(groups, cost.tolist(), audits, strict=True):
        want = cheapest(g, 2 if len(g) < 3 else 1)
        assert (c, a.decode()) == want[:2], g


def plain(rows):
    """The contract, row by row; edits come from a search over (row, state)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            word = text.strip(WHITE)
            k = 0 if not word else 1 if (role, text) in seen else 2 if word[-1] not in ".!?" else None
            seen.add((role, text))
            if k is not None:
                faults[k] += 1
            kinds.append((role[:1], k in (0, 1), k == 2))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = search(kinds, own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def search(kinds, own):
    """Forwards over (row, roles so far as a state), all cheapest audits compared as strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def offer(to, state, item):
        if state not in to or item[:2] < to[state][:2]:
            to[state] = item

    def inserts(of):
        for _ in range(4):
            for s, (c, a, kept) in list(of.items()):
                for x in "ua":
                    if (s, x) in step:
                        offer(of, step[s, x], (c + 3, a + "I", (*kept, ({"u": "user", "a": "assistant"}[x], ""))))
        return of

    for (initial, must, cut), (_, role, text) in zip(kinds, own, strict=True):
        to = {}
        for s, (c, a, kept) in inserts(best).items():
            offer(to, s, (c + 4, a + "D", kept))
            if not must and (s, initial) in step:
                offer(to, step[s, initial], (c + 3 * cut, a + "K", (*kept, (role, text))))
            for x, name in (("u", "user"), ("a", "assistant")):
                if not must and (s, x) in step:
                    offer(to, step[s, x], (c + 3 + 3 * cut, a + "R", (*kept, (name, text))))
        best = to
    return min(x for s, x in inserts(best).items() if s in ("", "a"))


def found(df, **limits):
    got = [tuple(r) for r in cv.repair(cv.damaged(df), **limits).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


def test_odd_rows(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "One. Two! Three?", "no end", "Ends.  \n", "é 漢字 😀.", "a\n.b", "x" * 3000 + ".", "\x1c."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "superuser"]
    rows = []
    for conv in [None, -3, *range(150)]:
        n = r.choice([1, 2, 3, 5, 9, 17])
        turns = [r.choice([None, 4, 4, *range(12), 100]) if conv and conv % 3 == 0 else t for t in range(n)]
        rows += [(conv, t, r.choice(roles), r.choice(texts)) for t in turns]
    rows += rows[:20] + [(7000, 3, "user", "the same.")] * 50 + [(7001, None, "user", "hello.")] * 3
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as initial", "'x' as h1", "true as blank", "2 as cut").repartition(3)
    want = plain(rows)
    assert found(df) == want
    assert found(df, most=60, most_bytes=4000, spool=300) == want
    assert found(spark.createDataFrame([], ROWS)) == {}


def test_long_conversation_goes_through_a_file(spark):
    r = random.Random(6)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text number {r.randint(0, 9000)}" + r.choice([".", "?", ""])) for t in range(6000)]
    rows += [(2, 0, "user", "y" * 1_500_000 + "."), (2, 1, "assistant", "ok.")]
    assert found(spark.createDataFrame(rows, ROWS), spool=10_000) == plain(rows)


def test_all_rows_dropped(spark):
    ids = [c for c in range(4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    got = found(spark.createDataFrame([(c, 0, "user", "Hello.") for c in ids], ROWS))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
