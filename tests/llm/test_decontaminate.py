import random
import time

import numpy as np

from ranqa.llm import decontaminate as D

BENCH = "item_id long, text string"


def brute(doc: list, item: list, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by trying every pair of starts, longest first."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and fd[d + n] and fi[i + n]):
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < m:
            return out
        out.append(best)
        fd[d:d + n] = [False] * n
        fi[i:i + n] = [False] * n


def test_tiling_matches_brute_force():
    rnd = random.Random(5)
    for size in (2, 3, 30):
        for _ in range(60):
            doc = [rnd.randrange(size) + 1 for _ in range(rnd.randrange(0, 60))]
            item = [rnd.randrange(size) + 1 for _ in range(rnd.randrange(0, 25))]
            if rnd.random() < 0.7 and len(item) > 10:
                cut = len(item) // 2
                doc[5:5] = item[cut:] + [99] + item[:cut]
            got = D.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 4)
            want = brute(doc, item, 4)
            for n, d, i in got:
                assert doc[d:d + n] == item[i:i + n]
            if size == 30:
                assert sorted(got) == sorted(want)
            elif want and got:  # ties may be marked in another order; the longest tile is the same
                assert max(got)[0] == max(want)[0]
            assert bool(got) == bool(want)


def fixture(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(20 + 3 * i)] for i in range(8)]
    bench = [(i, " ".join(w) + ".") for i, w in enumerate(items)] + [(3, " ".join(items[3])), (20, "a b"), (21, None), (22, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, filler(100), 1, "x") for i in range(30)]
    docs[4] = (4, filler(50) + " " + " ".join(items[3]).upper() + "! " + filler(9000), 1, "x")
    a = items[5]
    docs[7] = (7, " ".join(a[20:] + ["zz"] + a[10:20] + ["yy"] + a[:10]), 1, "x")  # reordered
    docs[9] = (9, filler(5) + " " + " ".join(items[2][:8]), 1, "x")  # too little
    docs += [(7, docs[7][1], 1, "x"), (40, None, 1, "x"), (41, "", 1, "x"), (None, bench[0][1], 1, "x")]
    return (spark.createDataFrame([(*d, "k", 2, "t") for d in docs], "doc_id long, text string, N_Items int, item_id string, __key string, __in0 int, found_n string"),
            spark.createDataFrame(bench, BENCH))


def test_finds_planted_and_reordered_items_both_ways(spark):
    docs, bench = fixture(spark)
    got = [sorted(map(str, D.decontaminate(docs, bench, broadcast_chars=n).select(
        "doc_id", "n_items", "item_ids", "max_coverage", "contaminated", "item_id", "__key", "__in0", "found_n").collect()))
        for n in (10**7, 0)]
    assert got[0] == got[1] and len(got[0]) == docs.count()
    rows = D.decontaminate(docs, bench).where("contaminated").collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in rows) == [("4", [3, 3]), ("7", [5]), ("7", [5]), ("None", [0])]
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_tokens_are_the_words():
    import pyarrow as pa

    from ranqa.llm.common import tokens

    rnd = random.Random(8)
    texts = [None, "", "a", " a", "a ", "ab", "AB cd", "ab\ncd", "éÉ x-y ... Z"]
    texts += ["".join(rnd.choice("ab, \n.é") for _ in range(rnd.randrange(40))) for _ in range(400)]
    texts += ["big " * 400_000, "x"]
    for bare in (False, True):
        clean = lambda w: "".join(c for c in w if c.isalnum()) if bare else w  # noqa: E731, B023
        want = [[w for w in map(clean, (t or "").lower().split()) if w] for t in texts]
        names: dict[int, str] = {}
        got = tokens(pa.array(texts), bare)
        assert [len(g) for g in got] == [len(w) for w in want]
        for g, w in zip(got, want):
            for h, word in zip(g.tolist(), w):
                assert names.setdefault(h, word) == word
        assert len(names) == len({w for ws in want for w in ws})


def words(text):
    return [w for w in ("".join(c for c in x if c.isalnum()) for x in (text or "").lower().split()) if w]


def covered(doc, item):
    return sum(n for n, _, _ in brute(words(doc), words(item), 5)) / len(words(item)) if len(words(item)) >= 5 else 0.0


def test_coverage_end_to_end_against_brute_force(spark):
    rnd = random.Random(12)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(rnd.randrange(0, 24)))) for i in range(14)]
    items += [items[6], (50, items[6][1]), (51, None)]
    docs = []
    for i in range(50):
        w = make(rnd.randrange(0, 30))
        for _ in range(rnd.randrange(0, 3)):  # parts of items, cut and moved
            x = words(items[rnd.randrange(14)][1])
            a = rnd.randrange(0, len(x) + 1)
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = x[a:a + rnd.randrange(3, 25)]
        docs.append((i, ", ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    want = {i: sorted(k for k, x in items if covered(t, x) >= 0.5) for i, t in docs}
    for chars in (10**7, 0):
        got = {r.doc_id: r for r in D.decontaminate(d, b, broadcast_chars=chars).collect()}
        assert {i: r.item_ids for i, r in got.items()} == want
        assert all(r.n_items == len(r.item_ids) and r.contaminated == bool(r.item_ids) for r in got.values())


def test_repeated_words_are_bounded_in_time():
    doc, item = np.full(60_000, 7, np.uint64), np.full(400, 7, np.uint64)
    t = time.time()
    assert D.tile(doc, item) == [(400, 0, 0)]
    assert D.tile(np.tile(np.array([3, 5], np.uint64), 5_000), np.tile(np.array([3, 5], np.uint64), 100)) == [(200, 0, 0)]
    assert time.time() - t < 20


def test_cost_follows_the_document_not_the_benchmark():
    rnd = np.random.default_rng(3)
    took = []
    for n in (400, 40_000):
        k = D.Items([], 5)
        k.tokens = [rnd.integers(1, 1 << 62, 60, dtype=np.uint64) for _ in range(n)]
        k.ids = list(range(n))
        flat = np.concatenate([D.rolling(t, 5) for t in k.tokens])
        order = np.argsort(flat)
        k.seeds, k.owner, k.place = flat[order], np.repeat(np.arange(n), 56)[order], np.tile(np.arange(56), n)[order]
        k.low = np.uint64((1 << max(16, (8 * len(flat)).bit_length())) - 1)
        k.maybe = np.zeros(int(k.low) + 1, bool)
        k.maybe[(flat & k.low).astype(np.int64)] = True
        docs = [rnd.integers(1, 1 << 62, 360, dtype=np.uint64) for _ in range(300)]
        t = time.time()
        assert all(k.coverage(d, 5, 0.5) == [] for d in docs)
        took.append((time.time() - t) / len(docs))
        assert k.coverage(np.concatenate([docs[0], k.tokens[7]]), 5, 0.5) == [(7, 1.0)]
    assert took[1] < 10 * took[0] + 1e-3, took
