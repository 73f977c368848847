import math

import pytest
from pyspark.sql import functions as F

from ranqa.functions.scoring import length_penalty, lev_ratio, minmax

# FIXTURES.md §3: length difference -> multiplier
PENALTY = {0: 1.0, 1: 0.9950124791926823, 5: 0.9753099120283326, 20: 0.9048374180359595,
           21: 0.5, 22: 0.5, 40: 0.5}


def test_penalty_golden(spark):
    df = spark.createDataFrame([(d,) for d in PENALTY], "d int")
    got = {r["d"]: r["p"] for r in df.select("d", length_penalty(F.col("d"), F.lit(0)).alias("p")).collect()}
    for d, want in PENALTY.items():
        assert got[d] == pytest.approx(want, abs=1e-15), d


def test_penalty_symmetric_and_bounded(spark):
    df = spark.range(0, 60).select(F.col("id").cast("int").alias("a"))
    df = df.crossJoin(df.select(F.col("a").alias("b")))
    rows = df.select(length_penalty("a", "b").alias("p"), length_penalty("b", "a").alias("q")).collect()
    assert all(0.5 <= r["p"] <= 1.0 and r["p"] == r["q"] for r in rows)


def test_minmax_guard(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 3.0), (1.0, 1.0, 3.0)], "x double, lo double, hi double")
    assert [r[0] for r in df.select(minmax("x", "lo", "hi")).collect()] == [1.0, 0.5, 0.0]


def test_lev_ratio(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc"), ("ab", "")], "a string, b string")
    got = [r[0] for r in df.select(lev_ratio("a", "b")).collect()]
    assert got == [round(100 * (7 - 3) / 7), 100, 100, 0]
    assert math.isclose(got[0], 57)
