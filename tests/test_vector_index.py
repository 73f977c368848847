import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranqa.operators import vector_index as VI
from ranqa.session import shared_dir
from ranqa.sources.tables import table

SCHEMA = "id long, embedding array<float>"


def exact(rows, queries, k, keep_self=False):
    def units(rs):
        ok = [(i, np.asarray(e, np.float32).astype(float)) for i, e in rs
              if e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)]
        return [i for i, _ in ok], [e / np.linalg.norm(e) for _, e in ok]

    ids, x = units(rows)
    out = []
    for q, v in zip(*units(queries)):
        best = sorted(((-round(float(v @ y), 9), i) for i, y in zip(ids, x) if len(y) == len(v) and (keep_self or i != q)))[:k]
        out += [(q, r + 1, i, round(-s, 6) + 0.0) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, queries, k, **kw):
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    VI.build_index(spark.createDataFrame(rows, SCHEMA).repartition(3), path, n_cells=kw.pop("n_cells", None))
    out = VI.search(spark, path, spark.createDataFrame(queries, SCHEMA), k, **kw)
    assert out.columns == ["query_id", "rank", "id", "score"]
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6) + 0.0) for r in out.collect())


def make(n, d, seed):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(6, d))
    x = centre[rnd.integers(0, 6, n)] + 0.4 * rnd.normal(size=(n, d))
    x[n // 2:] = x[0] + 0.05 * rnd.normal(size=(n - n // 2, d))  # half of all rows in one cell
    return [(int(i), v.tolist()) for i, v in zip(rnd.permutation(n), x.astype(np.float32))]


@pytest.mark.parametrize("cells,blocks", [(5, (64, 100)), (12, (4096, 4096))])
def test_exact_mode_equals_all_pairs(spark, cells, blocks):
    rows = make(240, 8, cells)
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [0.0] * 8), (1004, [float("nan")] * 8),
             (1005, [1.0, 2.0]), (1006, [None] * 8), (1007, [1e30] * 8)]
    ok = [r for r in rows if r[0] != 1005]
    assert run(spark, rows, rows, 5, exact=True, n_probe=2, n_cells=cells, member_block=blocks[0],
               query_block=blocks[1]) == exact(ok, ok, 5)


def test_few_vectors_and_own_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.1])]
    assert run(spark, rows, rows, 10, exact=True) == exact(rows, rows, 10)
    assert run(spark, rows, rows[:1], 2, exact=True, keep_self=True) == exact(rows, rows[:1], 2, keep_self=True)
    assert run(spark, [], rows, 3) == [] and run(spark, rows, [], 3) == []


def test_recall_of_probing(spark):
    """Whole embeddings as queries and index, probing a quarter of the cells: recall of the ten nearest."""
    sf = "/root/testdata/sf0.1"
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    VI.build_index(vecs, path, n_cells=16)
    near = {(r.query_id, r.id) for r in VI.search(spark, path, vecs, 10, n_probe=12).collect()}
    true = {(r.query_id, r.id) for r in VI.search(spark, path, vecs, 10, n_probe=4, exact=True).collect()}
    recall = len(near & true) / len(true)
    print("recall", recall)
    assert len(true) == 10 * vecs.count() and recall >= 0.9


def test_exact_mode_moves_no_vector_per_cell(spark):
    """The plan of the wide pass: blocks meet in a cross join; vectors are not shuffled once per cell that may hold a better one."""
    rows = make(400, 8, 3)
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    VI.build_index(spark.createDataFrame(rows, SCHEMA), path, n_cells=10)
    out = VI.search(spark, path, spark.createDataFrame(rows, SCHEMA), 3, exact=True, n_probe=2, query_block=50, member_block=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInArrow" not in plan
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 6) + 0.0) for r in out.collect())
    assert got == exact(rows, rows, 3)
