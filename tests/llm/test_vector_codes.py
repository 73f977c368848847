import hashlib

import numpy as np
import pytest

from ranqa.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, d):
    ok = [(k, [int(np.floor(256 * float(np.float32(v)))) for v in e], lab) for k, e, lab, _ in rows
          if e is not None and len(e) == d and all(v is not None and np.isfinite(v) for v in e)]
    w = -(-d // 16)
    x = [[(e + [0] * (16 * w - d))[p * w:(p + 1) * w] for p in range(16)] for _, e, _ in ok]
    first = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ok[i][1]))[:64]
    books = [[list(x[i][p]) for i in first] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p], c)), k) for k, c in enumerate(books[p])) for p in range(16)] for r in x]

    for _ in range(2):
        a = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = [r[p] for r, s in zip(x, a) if s[p][1] == k]
                if own:
                    books[p][k] = [sum(v) // len(own) for v in zip(*own)]
    a = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(k, "".join(f"{s[1]:02x}" for s in r), sum(s[0] for s in r), lab, digest) for (k, _, lab), r in zip(ok, a)]


def make(d, n, seed):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, d)) * 8) / 64  # few values, so prefixes and parts repeat
    rows = [(int(i), v.tolist(), [None, 1, 2][int(rnd.integers(3))], "x") for i, v in zip(rnd.permutation(n * 2), x.astype(np.float32))]
    rows += [rows[3], rows[3], (None, rows[4][1], 1, "x"), (rows[5][0], rows[6][1], 2, "x")]
    return rows + [(9001, None, 1, ""), (9002, [float("nan")] * d, 1, ""), (9003, [None] * d, 2, ""), (9004, [float("inf")] * d, 2, "")]


@pytest.mark.parametrize("d,n,bound", [(64, 300, 50_000), (16, 200, 50_000), (20, 40, 0), (5, 100, 0)])
def test_matches_brute_force(spark, d, n, bound):
    rows = make(d, n, d)
    got = V.compress(spark.createDataFrame(rows, SCHEMA).repartition(4), broadcast_rows=bound).collect()
    want = brute(rows, d)
    per = {}
    for r in want:
        per[r[3]] = per.get(r[3], 0) + r[2]
    assert sorted(map(tuple, got), key=str) == sorted(((k, c, e, per[lab], h) for k, c, e, lab, h in want), key=str)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_trie_finds_the_nearest_entry(block):
    rnd = np.random.default_rng(block)
    for width, spread in ((4, 3), (1, 50), (6, 2), (3, 1 << 22)):
        x = rnd.integers(-spread, spread + 1, (400, width))
        book = rnd.integers(-spread, spread + 1, (9, width))
        book[5] = book[2]  # ties go to the lower index
        own, place, count = V.distinct_parts(x)
        assert (own[place] == x).all() and count.sum() == len(x) and (np.lexsort(own.T[::-1]) == np.arange(len(own))).all()
        at, distance = V.nearest(own, book, block)
        d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert len(V.nearest(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))[0]) == 0


def test_wide_ranges_are_sorted_without_packing():
    x = np.array([[1 << 40, -5, 3], [-(1 << 40), 7, 3], [1 << 40, -5, 3], [0, 1 << 41, 0]])
    own, place, count = V.distinct_parts(x)
    assert (own[place] == x).all() and count.tolist() == [1, 1, 2]


def test_lengths_empty_vectors_and_empty_table(spark):
    rows = [(1, [1.0] * 16, 1, ""), (2, [2.0] * 16, 1, ""), (3, [0.5] * 32, 1, ""), (4, [], 2, ""), (5, [1e9] * 16, 2, "")]
    got = {r.vec_id: r for r in V.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].code == "01" * 16 and got[4].code == "00" * 16
    assert all(r.error == 0 and r.label_error == 0 for r in got.values())
    assert got[1].codebooks_sha256 == got[2].codebooks_sha256 != got[3].codebooks_sha256
    assert V.compress(spark.createDataFrame([], SCHEMA)).count() == 0
