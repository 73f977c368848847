"""One query holding most of the hits: same answers as the brute force, and
the plan cuts every list to `limit` rows per task before the shuffle."""

import random

from pyspark.sql import functions as F

from bruteforce import rerank_one
from ranqa.operators.rerank import rerank

SCHEMA = "query_id bigint, query_text string, hit_pos bigint, id bigint, question string, score double, p int, r int"


def test_hot_query(spark):
    rng = random.Random(7)
    texts = [f"text{i:03d}" for i in range(400)] + ["t", "tt", "much longer candidate text here"]
    cases = {}
    cases[0] = ("text123", [{"hit_pos": i, "id": i, "question": rng.choice(texts),
                             "score": float(rng.randint(0, 10000)) / 100,
                             "p": rng.randint(0, 100), "r": rng.randint(0, 100)} for i in range(100_000)])
    for q in range(1, 60):
        cases[q] = ("text007", [{"hit_pos": i, "id": q * 1000 + i, "question": rng.choice(texts[:20]),
                                 "score": float(rng.randint(0, 100)), "p": rng.randint(0, 100),
                                 "r": rng.randint(0, 100)} for i in range(rng.randint(1, 15))])
    rows = [(q, qt, h["hit_pos"], h["id"], h["question"], h["score"], h["p"], h["r"])
            for q, (qt, hits) in cases.items() for h in hits]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    out = rerank(df, gate_scorer=lambda a, b: F.col("p"), rank_scorer=lambda a, b: F.col("r"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q, (qt, hits) in cases.items():
        assert sorted(got.get(q, [])) == sorted(rerank_one(qt, hits)), q
    assert got.get(0)
