import numpy as np
import pytest

from ranqa.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string"


def whole(e):
    return np.floor(64 * np.asarray(e, np.float32).astype(float)).astype(np.int64)


def check(rows, got):
    """Against numpy's eigenvectors over the rows of one length."""
    ok = [(k, e) for k, e, _ in rows if e and all(v is not None and np.isfinite(v) for v in e)]
    x = np.array([whole(e) for _, e in ok])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > 1e-12 * e.sum()).sum()))
    assert len(got) == n * k and all(r.n == n for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    want: dict = {}
    for (vid, _), xi, ci in zip(ok, x, c):
        want.setdefault(vid, []).append((sum((n * int(a) - int(b)) ** 2 for a, b in zip(xi, s)), ci))
    for vid, ws in want.items():
        for j in range(1, k + 1):
            rs = by[vid][j]
            assert sorted(r.deviation for r in rs) == sorted(w[0] for w in ws)
            assert all(abs(r.explained - e[j - 1] / np.trace(v)) < 1e-9 for r in rs)
            if np.abs(np.delete(e, j - 1) - e[j - 1]).min(initial=np.inf) > 1e-4 * e[0]:  # its own direction
                mine = sorted(abs(r.whitened) for r in rs)
                assert np.allclose(mine, sorted(abs(w[1] @ u[:, j - 1]) / np.sqrt(e[j - 1]) for w in ws), atol=1e-6)
    first = min(want, key=str)
    y = np.array([[r.whitened for r in sorted(by[v][j], key=lambda r: r.deviation)] for v in want if len(want[v]) == 1
                  for j in range(1, k + 1)]).reshape(-1, k)
    if all(len(w) == 1 for w in want.values()):
        assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-6
    assert got and 0 <= by[first][1][0].identity_error < 1e-6


@pytest.mark.parametrize("d,n", [(64, 700), (5, 40), (40, 200), (1, 9)])
def test_matches_numpy(spark, d, n):
    rnd = np.random.default_rng(d)
    x = rnd.normal(size=(n, d)) * np.linspace(1, 0.3, d) + rnd.normal(size=d)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000, None, ""), (1001, [float("nan")] * d, ""), (1002, [None] * d, ""), (1003, [float("-inf")] * d, "")]
    check(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_equal_eigenvalues_and_repeats(spark):
    d = 6  # plus and minus every axis: one eigenvalue six times
    x = np.concatenate([np.eye(d), -np.eye(d)])
    rows = [(i, (3 * v).tolist(), "x") for i, v in enumerate(x)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    many = [(i, [0.0, 1.0, 2.0], "x") for i in range(50)] + [(7, [1.0, 5.0, 2.0], "x"), (None, [2.0, -1.0, 2.0], "x")]
    check(many, W.whiten(spark.createDataFrame(many, SCHEMA)).collect())


def test_spectrum_by_slices():
    rnd = np.random.default_rng(3)
    for values in ([5, 5, 5, 1], [1e6, 1, 1 + 1e-13, 1e-9, 0], list(np.linspace(1, 2, 40)), [0.0, 0.0], [3.0], [1, 1 - 1e-9, 1 - 1e-6]):
        q = np.linalg.qr(rnd.normal(size=(len(values), len(values))))[0]
        v = (q * np.array(values, float)) @ q.T
        v = (v + v.T) / 2
        e, u = W.leading_components(v, 32)
        want = np.sort(np.array(values, float))[::-1]
        want = want[want > 1e-12 * want.sum()][:32] if want.sum() else want[:0]
        assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-12 * max(values))
        assert np.abs(u @ u.T - np.eye(len(e))).max(initial=0) < 1e-10
        diagonal, off = W.tridiagonal(v)
        assert W.counts_above(diagonal, off, np.array([-1.0, max(values) + 1.0])).tolist() == [len(values), 0]


def test_large_entries_lengths_and_empty(spark):
    assert W.deviations(np.array([[1 << 30], [-1 << 30]]), 1 << 20, [0]) == [None, None]
    assert W.deviations(np.array([[3, 4]]), 2, [1, 1]) == [25 + 49]
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0, 1.0], "a"), (3, [1.0], "a"), (4, [3.0], "a"), (5, [], "a"), (6, [1e30], "a")]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame(rows[:1], SCHEMA)).columns == [c.split()[0] for c in W.RESULT.split(", ")]
