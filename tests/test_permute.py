import pytest
from pyspark.sql import functions as F

from ranqa.operators.permute import in_permuted_order, permuted, round_keys


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 1000, 4097])
def test_bijection_of_any_size(spark, n):
    got = [r.p for r in spark.range(n).repartition(3).select(permuted("id", n).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_places_look_shuffled_and_follow_the_seed(spark):
    n = 3000
    df = spark.range(n).select("id", permuted("id", n).alias("p"), permuted("id", n, 7).alias("q"))
    rows = df.collect()
    assert sum(r.p == r.q for r in rows) < 20 and sum(r.p == r.id for r in rows) < 20
    moved = [abs(r.p - r.id) for r in rows]
    assert 0.28 * n < sum(moved) / n < 0.39 * n           # a third of n on average
    rises = sum(a.p < b.p for a, b in zip(sorted(rows), sorted(rows)[1:]))
    assert 0.45 * n < rises < 0.55 * n
    assert len(set(round_keys(42))) == 24


def test_large_numbers_stay_in_range(spark):
    n = (1 << 45) + 7
    got = [r.p for r in spark.range(0, 1 << 45, 1 << 38).select(permuted("id", n).alias("p")).collect()]
    assert len(set(got)) == len(got) and all(0 <= p < n for p in got) and max(got) > n // 2


def test_same_order_at_any_partitioning_and_one_exchange(spark):
    n = 500
    orders = []
    for parts in (1, 7):
        df = spark.range(n).repartition(parts).withColumn("place", permuted("id", n))
        out = in_permuted_order(df.where("id % 5 <> 0"), "place", n, 4)  # gaps
        orders.append([r.id for r in out.collect()])
    assert orders[0] == orders[1] and len(orders[0]) == 400
    plan = in_permuted_order(spark.range(n).withColumn("place", permuted("id", n)), "place", n, 4)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()
    empty = spark.range(0).withColumn("place", permuted("id", F.lit(1)))
    assert in_permuted_order(empty, "place", 0, 3).count() == 0
