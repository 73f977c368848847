import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from ranqa.functions import blocks as B


def ratio(a, b):
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    return int(round(100 * SequenceMatcher(None, a, b).ratio())) if a and b else 0


def partial(a, b):
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    if not a or not b:
        return 0
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for m in SequenceMatcher(None, s, l).get_matching_blocks():
        at = max(m.b - m.a, 0)
        r = SequenceMatcher(None, s, l[at:at + len(s)]).ratio()
        if r > 0.995:
            return 100
        best = max(best, r)
    return int(round(100 * best))


def weighted(a, b):
    if a is None or b is None:
        return 0
    a, b = (re.sub(r"\W", " ", re.sub("[\x80-\xff]", "", t)).lower().strip() for t in (a, b))
    if not a or not b:
        return 0

    def by_sort(f):
        return f(" ".join(sorted(a.split())), " ".join(sorted(b.split())))

    def by_set(f):
        if a == b:
            return 100
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        l, r = ((both + " " + " ".join(sorted(t))).strip() for t in (x - y, y - x))
        return max(f(both, l), f(both, r), f(l, r))

    base = ratio(a, b)
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return int(round(max(base, 0.95 * by_sort(ratio), 0.95 * by_set(ratio))))
    p = 0.6 if apart > 8 else 0.9
    return int(round(max(base, p * partial(a, b), 0.95 * p * by_sort(partial), 0.95 * p * by_set(partial))))


WORDS = ["ring", "small", "Ring", "widget", "云手机", "移动云手机", "套餐", "办理", "流程", "5G", "éa", "ÄÖ", "!!", "a", "b", "办", "x_y", "\U0001F600"]
FIXED = [None, "", " ", "云手机", "移动云手机", "专线", "网络", "small ring", "red widget", "!!!", "ring small", "a" * 300, "ab" * 150, "云" * 250 + "手机"]


def texts():
    rnd = random.Random(3)
    out = list(FIXED)
    for _ in range(120):
        out.append(rnd.choice(["", " ", "  "]).join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 8))))
    for _ in range(40):
        out.append("".join(rnd.choice("ab云机 ") for _ in range(rnd.choice([3, 8, 20, 63, 64, 65, 90]))))
    for _ in range(6):  # long enough for the popular-character rule
        out.append("".join(rnd.choice("abcdefghij 云手机") for _ in range(rnd.randrange(190, 420))))
    return out


PAIRS = list(itertools.product(texts()[:60], texts()[:60])) + list(itertools.islice(itertools.product(texts()[60:], texts()[::-1]), 6000))


def test_known_values():
    assert partial("云手机", "移动云手机") == B.partial_ratios(["云手机"], ["移动云手机"])[0] == 100
    assert B.partial_ratios(["专线"], ["网络"])[0] == 0 and B.partial_ratios(["small ring"], ["red widget"])[0] == 30


@pytest.mark.parametrize("mine,theirs", [(B.ratios, ratio), (B.partial_ratios, partial), (B.weighted_ratios, weighted)])
def test_equal_to_the_standard_library(mine, theirs):
    a, b = [p[0] for p in PAIRS], [p[1] for p in PAIRS]
    got = mine(a, b)
    wrong = [(s, t, int(g), theirs(s, t)) for s, t, g in zip(a, b, got) if g != theirs(s, t)]
    assert not wrong, wrong[:5]
    assert len(mine([], [])) == 0


def test_blocks_are_those_of_the_sequence_matcher():
    rnd = random.Random(9)
    a = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    b = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    got: dict = {}
    for p, i, j, n in zip(*B.matching_blocks(a, b)):
        got.setdefault(int(p), []).append((int(i), int(j), int(n)))
    for k, (s, t) in enumerate(zip(a, b)):
        merged: list = []  # the library joins blocks that touch
        for i, j, n in sorted(got.get(k, [])):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == [tuple(m) for m in SequenceMatcher(None, s, t).get_matching_blocks()[:-1]]


def test_columns(spark):
    rows = [("云手机", "移动云手机", 1), ("", "", 2), (None, "a", 3), ("Small, ring!", "ring small", 4)]
    df = spark.createDataFrame(rows, "a string, b string, k int").repartition(2)
    got = {r.k: (r.r, r.p, r.w, r.c) for r in df.select(
        "k", B.ratio("a", "b").alias("r"), B.partial_ratio("a", "b").alias("p"), B.weighted_ratio("a", "b").alias("w"),
        B.clean("a").alias("c")).collect()}
    assert got == {k: (ratio(a, b), partial(a, b), weighted(a, b), None if a is None else B.cleaned(a)) for a, b, k in rows}
    assert np.all(B.ratios([None], [None]) == 0)
