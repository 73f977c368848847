import math
import random
import time

import pytest

from ranqa.operators import segment
from ranqa.operators.segment import Lattice, segmenter, word_counts
from ranqa.operators.stopwords import remove_stopwords


def best_paths(text, words, single):
    """Largest log probability over all ways to cut the text."""
    best = {len(text): 0.0}
    for i in range(len(text) - 1, -1, -1):
        best[i] = max([words[text[i:j]] + best[j] for j in range(i + 1, len(text) + 1) if text[i:j] in words]
                      + [single + best[i + 1]] * (text[i] not in words))
    return best[0]


def test_path_has_the_largest_probability():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {"".join(rnd.choice("ab云") for _ in range(rnd.randrange(1, 5))): rnd.randrange(1, 50) for _ in range(6)}
        lattice = Lattice(counts.items())
        text = "".join(rnd.choice("ab云c") for _ in range(rnd.randrange(0, 12)))
        cut = lattice.cut(text)
        assert "".join(cut) == text
        got = sum(lattice.words.get(w, lattice.single) for w in cut)
        assert math.isclose(got, best_paths(text, lattice.words, lattice.single), abs_tol=1e-9)
        assert all(w in lattice.words or len(w) == 1 for w in cut)


def test_counts_beat_the_longest_match():
    counts = [("研究", 50), ("研究生", 2), ("生命", 40), ("起源", 30), ("命", 1)]
    assert Lattice(counts).cut("研究生命起源") == ["研究", "生命", "起源"]
    assert Lattice(counts, ["云手机"]).cut("研究云手机") == ["研究", "云手机"]
    assert Lattice(counts).cut("云手机") == ["云", "手", "机"] and Lattice([]).cut("ab") == ["a", "b"] and Lattice([]).cut("") == []


def test_columns(spark):
    docs = spark.createDataFrame([(1, "我要 办理 云手机 我要 业务"), (2, "业务 办理\n我要"), (3, None), (4, "")], "id int, text string")
    counts = word_counts(docs)
    assert sorted(map(tuple, counts.collect())) == sorted([("我要", 3), ("办理", 2), ("云手机", 1), ("业务", 2)])
    assert [r.word for r in word_counts(docs, max_words=1).collect()] == ["我要"]
    cut = segmenter(spark, counts, ["资费"])
    df = spark.createDataFrame([(1, "我要办理云手机资费"), (2, None), (3, "")], "id int, t string")
    got = {r.id: (r.w, r.s) for r in df.select("id", cut("t").alias("w"), remove_stopwords("t", ["我要"], segmenter=cut).alias("s")).collect()}
    assert got[1] == (["我要", "办理", "云手机", "资费"], "办理云手机资费") and got[2][0] is None and got[3] == ([], "")
    with pytest.raises(ValueError):
        segmenter(spark, counts, max_words=2)


def plain_cut(lattice, text):
    """The best path place by place, sums from the text's end, of equal ones the longer first word."""
    n, longest = len(text), max(map(len, lattice.words), default=1)
    best, step = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best[i], step[i] = best[i + 1] + lattice.words.get(text[i], lattice.single), i + 1
        for j in range(i + 2, min(n, i + longest) + 1):
            weight = lattice.words.get(text[i:j])
            if weight is not None and weight + best[j] >= best[i]:
                best[i], step[i] = weight + best[j], j
    out, i = [], 0
    while i < n:
        out.append(text[i:step[i]])
        i = step[i]
    return out


@pytest.mark.parametrize("dense,together,long", [(1 << 22, 1 << 18, 512), (0, 3, 2), (10, 20, 4)])
def test_many_texts_at_once_are_cut_like_one_by_one(monkeypatch, dense, together, long):
    for name, value in (("DENSE", dense), ("TOGETHER", together), ("LONG", long)):
        monkeypatch.setattr(segment, name, value)
    rnd = random.Random(together)
    for _ in range(300):  # counts of 1 and 2: many ways of equal probability
        counts = {"".join(rnd.choice("ab云𝄞\0") for _ in range(rnd.randrange(6))): rnd.randrange(1, 3) for _ in range(rnd.randrange(9))}
        lattice = Lattice(counts.items(), [rnd.choice(["", "ab", "c云a"])])
        texts = ["".join(rnd.choice("ab云c𝄞\0 ") for _ in range(rnd.randrange(30))) for _ in range(5)]
        assert lattice.cut_all(texts) == [plain_cut(lattice, t) for t in texts]


def test_cutting_keeps_little_work_per_character():
    """Less processor time than trying one prefix after the other at every place."""
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 9))): rnd.randrange(1, 1000) for _ in range(40_000)}
    lattice, words = Lattice(counts.items()), list(counts)
    texts = ["".join(rnd.choice(words) for _ in range(400)) for _ in range(40)]
    prefixes = {w[:k] for w in words for k in range(1, len(w))}

    def step_by_step(text):
        n = len(text)
        best, step = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            piece, j = text[i], i + 1
            top, to = best[j] + lattice.words.get(piece, lattice.single), j
            while piece in prefixes and j < n:
                j += 1
                piece = text[i:j]
                weight = lattice.words.get(piece)
                if weight is not None and weight + best[j] >= top:
                    top, to = weight + best[j], j
            best[i], step[i] = top, to
        return best[0]

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    old = min(seconds(lambda: [step_by_step(t) for t in texts]) for _ in range(2))
    new = min(seconds(lambda: lattice.cut_all(texts)) for _ in range(2))
    assert new < old
