import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ranqa.functions import blocks, fuzzy
from ranqa.functions.scoring import lev_ratio
from ranqa.operators import fuzzy_index as FI

WORDS = ["small", "red", "ring", "widget", "blue", "bolt", "gear", "hot", "gizmo", "Red", "云手机", "套餐", "办理", "x", "!", "é"]


def tables(spark, n=400):
    rnd = random.Random(4)
    name = lambda m: rnd.choice(["", " ", " "]).join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, m)))
    rows = [(i, name(6), "x") for i in range(n)] + [(1000 + i, "red ring", "x") for i in range(60)] + [(5, None, "x"), (2000, "", "x")]
    probes = [(i, name(5)) for i in range(12)] + [(50, "xxx"), (51, ""), (52, None), (53, "red ring"), (54, "ffffffff"),
                                                  (55, "small red ring with a very long tail of other words")]
    return (spark.createDataFrame(probes, "probe_id long, probe_text string"),
            spark.createDataFrame(rows, "id long, name string, fuzzy string").repartition(3))


def every_pair(probes, catalog, k, scorer):
    pairs = probes.where("probe_text is not null").crossJoin(catalog.where("name is not null").select("id", "name"))
    w = Window.partitionBy("probe_id").orderBy(F.desc("fuzzy"), "id")
    return (pairs.withColumn("fuzzy", scorer(F.col("probe_text"), F.col("name"))).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).select("probe_id", "probe_text", "rank", "id", "name", "fuzzy"))


@pytest.mark.parametrize("scorer", [lev_ratio, fuzzy.window_ratio, fuzzy.weighted_ratio, blocks.ratio, blocks.partial_ratio,
                                    blocks.weighted_ratio])
def test_same_rows_as_every_pair(spark, scorer):
    probes, catalog = tables(spark, 250)
    got = FI.fuzzy_catalog_topk(probes, catalog, k=5, scorer=scorer, entry_block=60, probe_block=7)
    assert got.columns == ["probe_id", "probe_text", "rank", "id", "name", "fuzzy"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every_pair(probes, catalog, 5, scorer).collect()))


@pytest.mark.parametrize("scorer", [lev_ratio, blocks.weighted_ratio])
def test_bounds_hold_and_save_work(spark, scorer):
    bound = FI.BOUNDS[scorer]
    probes, catalog = tables(spark, 120)
    forms = lambda df, c: df.where(f"{c} is not null").select(c, bound.form(F.col(c)).alias("form")).distinct().collect()
    p, e = forms(probes, "probe_text"), forms(catalog, "name")
    score = {(r.probe_text, r.name): r.s for r in probes.where("probe_text is not null").select("probe_text").crossJoin(
        catalog.where("name is not null").select("name").distinct()).withColumn(
        "s", scorer(F.col("probe_text"), F.col("name"))).collect()}
    index = FI.TextIndex([r.form for r in e], bound)
    for r in p:
        most = index.most(r.form)
        assert all(score[r.probe_text, x.name] <= m for x, m in zip(e, most))
    named = probes.where("length(probe_text) > 3 and probe_text not in ('xxx', 'ffffffff')")
    met = FI.candidate_pairs(named, catalog, k=3, scorer=scorer).count()
    assert met < 0.5 * named.count() * len(e)


def test_scorer_without_bound_and_empty_tables(spark):
    probes, catalog = tables(spark, 40)
    by_length = lambda a, b: (F.lit(100) - F.abs(F.length(a) - F.length(b))).cast("int")
    got = FI.fuzzy_catalog_topk(probes, catalog, k=4, scorer=by_length, entry_block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every_pair(probes, catalog, 4, by_length).collect()))
    assert FI.fuzzy_catalog_topk(probes.limit(0), catalog).count() == 0
    assert FI.fuzzy_catalog_topk(probes, catalog.limit(0)).count() == 0
    few = FI.fuzzy_catalog_topk(probes, catalog.where("id < 3"), k=8).collect()
    assert len(few) == 3 * 17
