import numpy as np
import pytest

from ranqa.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    ok = [i for i, (k, e, _) in enumerate(rows) if k is not None and e
          and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    near = np.zeros((len(ok), len(ok)), bool)
    for d in {len(rows[i][1]) for i in ok}:  # vectors of one length
        own = [a for a, i in enumerate(ok) if len(rows[i][1]) == d]
        x = np.array([np.asarray(rows[ok[a]][1], np.float32) for a in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(own, own)] = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.array([rows[i][0] for i in ok])
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ok))])
        if (new == comp).all():
            break
        comp = new
    out = [(k, 0, k, True) for i, (k, _, _) in enumerate(rows) if i not in set(ok)]
    out += [(rows[i][0], int(near[a].sum()), int(comp[a]), rows[i][0] == comp[a]) for a, i in enumerate(ok)]
    return sorted(out, key=str)


def make(d, n, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d))
    x = [base]
    for i in range(0, n, 7):  # groups of near copies, some at the edge of the bound
        for s in (0.05, 0.2, 0.3):
            x.append(base[i] + s * rnd.normal(size=(3, d)) * np.linalg.norm(base[i]) / np.sqrt(d))
    x.append(base[0] + 0.03 * rnd.normal(size=(150, d)))
    x = np.concatenate(x).astype(np.float32)
    rows = [(1000 + i, v.tolist(), "x") for i, v in enumerate(x)]
    rnd.shuffle(rows)
    rows = [(int(a), b, c) for a, b, c in rows]
    same = rows[5]
    rows += [(5000 + i, same[1], "x") for i in range(20)] + [same, (7, [2 * v for v in same[1]], "x")]
    bad = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * (d + 1)]
    return rows + [(6000 + i, b, "x") for i, b in enumerate(bad)] + [(None, same[1], "x")]


@pytest.mark.parametrize("d,z,blocks", [(24, None, (16, 64)), (64, E.Z, (2048, 16384)), (3, E.Z, (100, 100))])
def test_matches_brute_force(spark, d, z, blocks):
    rows = make(d, 150, d)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = E.near_copies(df, z=z, cell_rows=60, home_block=blocks[0], query_block=blocks[1])
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_drifting_families(spark):
    """Vectors along arcs: the displacement of linked vectors lies along the line between two centres."""
    rnd = np.random.default_rng(4)
    x = []
    for _ in range(30):
        a, b = np.linalg.qr(rnd.normal(size=(200, 2)))[0].T
        t = rnd.uniform(0, 1.2, size=(90, 1))
        x.append(np.cos(t) * a + np.sin(t) * b + 0.002 * rnd.normal(size=(90, 200)))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.concatenate(x).astype(np.float32))]
    out = E.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4), cell_rows=40)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_all_lengths_and_ids_with_several_vectors(spark):
    rows = [(10, [1.0, 1.0], "x"), (11, [1.0, 1.0], "x"), (12, [-1.0, 0.5], "x"), (20, [0.0, 0.0, 1.0, 0.0], "x"),
            (20, [0.0, 0.0, 1.0, 0.01], "x"), (21, [0.0, 0.0, -1.0, 0.01], "x"), (5, [0.0, 0.0, 2.0, 0.02], "x"), (30, [3.0], "x"),
            (31, [4.0], "x"), (32, [-1.0], "x"), (1, [0.0, 0.0, 1.0, 0.0], "x"), (1, [1.0, 1.05], "x"), (1, [0.0, 5.0, 0.0, 0.0], "x")]
    rows += [(100 + i, r[1], "x") for i, r in enumerate(make(24, 60, 2)) if r[1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in E.near_copies(df, cell_rows=20, sample_rows=80).collect()), key=str) == brute(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.near_copies(df).count() == 0
    assert E.near_copies(spark.createDataFrame([(1, None, "")], SCHEMA)).collect()[0].kept
    one = E.near_copies(spark.createDataFrame([(4, [1.0, 2.0], "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4, True)]
