import random
import re

import numpy as np
import pyarrow as pa

from ranqa.llm import license_scan as L

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text, phrases=L.PHRASES):
    w = words(text)
    places = sorted((i, lab) for lab, ph in phrases for i in range(len(w)) if words(ph) and w[i:i + len(words(ph))] == words(ph))
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({p[1] for p in places}))


TEXTS = [None, "", "CC BY", "cc-by cc by cc\nBY", "ÉCC BY", "ccby", "All Rights Reserved. all rights\x00reserved", "İ cc by é",
         "GNU General PUBLIC License general public license", "all rights all rights reserved", "cc by" * 5, "1cc by 2 cc  by3",
         "\x7fcc\x7fby", "a" * 100_000, "cc by " * 20_000, "\U0001F600cc by \U0001F600 cc by"]


def test_base_reading(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(None, "CC BY", "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, LABELS string, __in0 int")
    got = L.scan_licenses(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(
        (str(d), a, b, str(c), str(e), f) for d, t, *_ in rows for a, b, c, e, f in [base(t)])
    assert all(r.score == 1.0 and set(r.base_labels) <= set(r.labels) for r in got if r.n_base)
    assert L.scan_licenses(df.limit(0)).count() == 0


def substrings(t):
    return {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


def test_automaton_against_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        texts = [[rnd.randrange(3) for _ in range(rnd.randrange(0, 9))] for _ in range(rnd.randrange(1, 4))]
        a = L.Automaton(texts)
        known = set().union(*map(substrings, texts)) if texts else set()
        assert sum(n - a.length[up] for n, up in zip(a.length[1:], a.link[1:])) == len(known)
        doc = [rnd.randrange(4) for _ in range(30)]
        s = L.Scanner.__new__(L.Scanner)
        s.automaton = a
        for i, (state, n) in enumerate(s.statistics(doc)):
            want = max((m for m in range(i + 2) if m == 0 or tuple(doc[i + 1 - m:i + 1]) in known), default=0)
            assert n == want
            if n:
                ends = sorted((t, e) for t, x in enumerate(texts) for e in range(n, len(x) + 1) if x[e - n:e] == doc[i + 1 - n:i + 1])
                # places are those of the state's longest string and all shorter ones of it alike
                assert a.places(state) == ends


def test_phrases_and_spans_against_brute_force():
    rnd = random.Random(8)
    vocab = list("abcde")
    for _ in range(80):
        make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
        phrases = [(f"p{k}", make(rnd.randrange(0, 4))) for k in range(3)]
        templates = [(f"t{k}", make(rnd.randrange(1, 9))) for k in range(3)]
        s = L.Scanner(phrases, templates, min_match=2, max_gap=2, min_coverage=1.0)
        doc = " ".join(rnd.choice([*vocab, "z", *(t for _, t in templates)]) for _ in range(12))
        places, spans = s.scan(L.word_hashes(pa.array([doc]))[0])
        n, count, first, last, labels = base(doc, phrases)
        assert (len(places), sorted({phrases[k][0] for _, k in places})) == (count, labels)
        if places:
            assert (places[0][0], places[-1][0]) == (first, last)
        w = words(doc)
        found = {s.labels[t] for t, *_ in spans}
        for lab, text in templates:  # a template that stands in the document as it is is found
            t = words(text)
            if len(t) >= 2 and any(w[i:i + len(t)] == t for i in range(len(w))):
                assert lab in found, (text, doc)


def test_notices_with_changes():
    s = L.Scanner(L.PHRASES, L.TEMPLATES)

    def labels(text):
        return s.columns(pa.array([text]))[6][0].as_py()

    mit = next(t for lab, t in L.TEMPLATES if lab == "mit" and len(t) > 200)
    assert labels("Copyright 2020 X\n\n# " + mit.replace(" ", "\n * ")) == ["mit"]
    assert labels(mit.replace("the Software", "this Library")) == ["mit"]     # changed words, chained
    w = mit.split()
    assert labels(" ".join(w[:10])) == [] and labels(" ".join(reversed(w))) == []
    assert labels("foo. Licensed under the Apache License, Version 2.0. bar") == ["apache-2.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl", "gpl-3.0"]
    assert labels("the general public was told to use, copy and modify the plan under the version 2 of the law") == []
    text = "x " * 50 + mit + " y " * 40 + mit
    spans = s.columns(pa.array([text]))[5][0].as_py()
    n = len(words(mit))
    assert [(x["label"], x["first_word"], x["end_word"], x["coverage"]) for x in spans] == [
        ("mit", 50, 50 + n, 1.0), ("mit", 90 + n, 90 + 2 * n, 1.0)]


def test_chain_prefers_the_nearest_and_counts_overlaps_once():
    assert L.chain([(0, 0, 5), (7, 6, 4)], 3) == [(9, 0, 11)]
    assert L.chain([(0, 0, 5), (20, 6, 4)], 3) == [(5, 0, 5), (4, 20, 24)]
    assert L.chain([(0, 0, 6), (4, 4, 6)], 3) == [(10, 0, 10)]
    two = [(0, 0, 5), (6, 6, 4), (12, 0, 5), (18, 6, 4)]
    assert sorted(L.chain(two, 12)) == [(9, 0, 10), (9, 12, 22)]
    rnd = np.random.default_rng(1)
    many = sorted((int(d), int(t), 4) for d, t in zip(rnd.integers(0, 100_000, 20_000), rnd.integers(0, 100, 20_000)))
    assert sum(c[0] for c in L.chain(many, 12)) > 0
