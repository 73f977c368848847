import pytest
from pyspark.sql import functions as F

from ranqa.operators import templates as TP
from ranqa.operators.indexing import dense_index, dense_index_counted


def test_distributed_dense_index(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k")).distinct()
    idx = dense_index(df, ["k"], num_partitions=5).collect()
    pairs = sorted((r["idx"], r["k"]) for r in idx)
    assert [p[0] for p in pairs] == list(range(len(pairs)))
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)


def test_counted_paths_agree(spark):
    df = spark.range(0, 300, 1, 4).select((F.col("id") * 13 % 301).alias("k"))
    a, n = dense_index_counted(df, ["k"])
    b = dense_index(df, ["k"], num_partitions=3)
    c, m = dense_index_counted(df, ["k"], small_rows=10)
    assert n == m == 300
    assert (sorted(map(tuple, a.select("k", "idx").collect())) == sorted(map(tuple, b.select("k", "idx").collect()))
            == sorted(map(tuple, c.select("k", "idx").collect())))


@pytest.mark.parametrize("small", [1000, 5])
def test_repeated_and_null_keys_get_one_position_each(spark, small):
    rows = [(1, "b"), (1, "a"), (2, "x"), (None, "n"), (1, "a"), (None, "m")] + [(7, "hot")] * 40
    got = {}
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "k int, v string").repartition(parts)
        idx, n = dense_index_counted(df, ["k"], small_rows=small)
        out = sorted((r.idx, r.k, r.v) for r in idx.collect())
        assert n == len(rows) and [o[0] for o in out] == list(range(len(rows)))
        assert [o[1] for o in out] == [None] * 2 + [1] * 3 + [2] + [7] * 40
        got[parts] = out
    assert got[1] == got[6]  # whatever the partitioning


def test_generators_keep_every_row_of_repeated_templates(spark):
    t = spark.createDataFrame([(5, "a"), (5, "b"), (5, "b")], "template_id int, template string")
    for made in (TP.no_entity_questions(t), TP.negative_questions(t)):
        out = made.collect()
        assert sorted(r.id for r in out) == [1, 2, 3] and sorted(r.question for r in out) == ["a", "b", "b"]
    cat = spark.createDataFrame([("x",), ("y",)], "name string")
    base = TP.expand_base(t, cat, num_samples=4).collect()
    assert sorted(r.id for r in base) == list(range(1, 13))
