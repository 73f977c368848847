import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ranqa.operators.segment import Lattice, segmenter, word_counts
from ranqa.operators.word_shapes import FOLLOWS, WordShapes, character_states, model_rows


def plain_states(texts, max_length=32):
    """Counts of places and moves, word by word."""
    out = {}
    for t in texts:
        words = (t or "").split()
        for w, after in itertools.zip_longest(words, words[1:]):
            if len(w) > max_length:
                continue
            places = "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E"
            follow = places[1:] + ("" if after is None else "S" if len(after) == 1 else "B")
            for key in [*((p, None, c) for p, c in zip(places, w)), *((p, f, None) for p, f in zip(places, follow))]:
                out[key] = out.get(key, 0) + 1
    return out


def all_cuts(run):
    for bits in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *(k + 1 for k, b in enumerate(bits) if b), len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def likelihood(model, words):
    places = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
    run = "".join(words)
    return (model.first[places[0]] + sum(model.moved[a][b] for a, b in zip(places, places[1:]))
            + sum(model.shown[p].get(c, model.unseen[p]) for p, c in zip(places, run)))


TEXTS = ["我要 办理 云手机 a\n我要", "x y zz", None, "", "   ", "𠀀𠀁 é 😀x " + "w" * 40 + " q", "我要"]


def test_counts_equal_word_by_word(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [((r.state, r.next, r.character), r.n) for r in character_states(docs).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain_states(TEXTS)
    assert character_states(docs.limit(0)).count() == 0


def test_model_keeps_moves_and_frequent_characters(spark):
    states = character_states(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    moves = {(r.state, r.next) for r in states.where("next is not null").collect()}
    rows = model_rows(states, len(moves) + 1)
    assert {(s, n) for s, n, c, _ in rows if c is None} == moves
    assert [r[3] for r in rows if r[2] is not None] == [states.where("character is not null").agg({"n": "max"}).first()[0]]


@pytest.mark.parametrize("seed", range(4))
def test_cut_is_the_most_probable(seed):
    rnd = random.Random(seed)
    states = [(s, None, c, rnd.randrange(1, 40)) for s in FOLLOWS for c in "abc云" if rnd.random() < 0.8]
    states += [(s, t, None, rnd.randrange(1, 40)) for s, to in FOLLOWS.items() for t in to if rnd.random() < 0.9]
    model = WordShapes(states)
    for _ in range(60):
        run = "".join(rnd.choice("abc云z") for _ in range(rnd.randrange(1, 9)))
        words = model.cut(run)
        assert "".join(words) == run and all(words)
        assert math.isclose(likelihood(model, words), max(likelihood(model, c) for c in all_cuts(run)), abs_tol=1e-9)
    assert model.cut("") == [] and WordShapes([]).cut("ab") in (["ab"], ["a", "b"])


def test_only_runs_with_an_unknown_character_change():
    model = WordShapes([("B", None, "云", 9), ("M", None, "手", 9), ("E", None, "机", 9), ("B", "M", None, 9), ("M", "E", None, 9),
                        ("E", "B", None, 9)])
    counts = [("我要", 50), ("办理", 40), ("a", 30), ("b", 30)]
    assert Lattice(counts).cut("我要云手机办理") == ["我要", "云", "手", "机", "办理"]
    assert Lattice(counts, (), model).cut("我要云手机办理") == ["我要", "云手机", "办理"]
    assert Lattice(counts, (), model).cut("ab我要ab") == ["a", "b", "我要", "a", "b"]  # all known
    assert Lattice(counts, (), model).cut("云手机 云手机\n") == ["云手机", " ", "云手机", "\n"]
    assert Lattice(counts, (), model).cut("") == []


def same_ends(found, spaced):
    ends = lambda ws: set(itertools.accumulate(map(len, ws)))
    a, b = ends(found), ends(spaced)
    return len(a & b), len(a), len(b)


def test_unknown_words_of_held_out_texts_are_found_better_than_without(spark):
    rnd = random.Random(5)
    syllable = lambda: rnd.choice("BCDFG") + rnd.choice("aeiou") + rnd.choice("xyz")
    words = sorted({"".join(syllable() for _ in range(rnd.randrange(1, 2))) + rnd.choice(["", "n", "r"]) for _ in range(160)})
    known, unknown = words[::2], words[1::2]
    texts = [[rnd.choice(known if rnd.random() < 0.7 else unknown) for _ in range(60)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts[:30])], "id int, text string")
    counts = word_counts(docs).where(~F.col("word").isin(unknown))
    held = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts[30:])], "id int, text string")
    plain, shaped = segmenter(spark, counts), segmenter(spark, counts, states=character_states(docs))
    rows = sorted(held.select("id", plain("text").alias("p"), shaped("text").alias("s")).collect())
    f1 = {}
    for name in ("p", "s"):
        same, cut, true = map(sum, zip(*(same_ends(r[name], t) for r, t in zip(rows, texts[30:]))))
        f1[name] = 2 * same / (cut + true)
    assert f1["s"] > 0.95 and f1["s"] > f1["p"] + 0.1, f1
