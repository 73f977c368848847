import random

from pyspark.sql import functions as F

from bruteforce import rerank_one
from ranqa.operators.rerank import rerank

SCHEMA = "query_id bigint, query_text string, hit_pos bigint, id bigint, question string, score double, p int, r int"
WORDS = ["ab", "abc", "abcd", "xyzzy", "abcdefghij", "q", "abcdefghijklmnopqrstuvwxyz0123"]


def _random_case(rng: random.Random, qid: int):
    n = rng.randint(0, 12)
    query = rng.choice(WORDS)
    texts = rng.sample(WORDS, rng.randint(1, len(WORDS)))
    hits = []
    for pos in range(n):
        q = None if rng.random() < 0.1 else rng.choice(texts)
        score = float(rng.choice([5, 10, 15, 16, 20, 25, 30, 40, 40, 55, 70, 90, 100]))
        hits.append({"hit_pos": pos, "id": qid * 100 + pos, "question": q, "score": score,
                     "p": rng.choice([0, 40, 50, 51, 60, 90, 100]), "r": rng.choice([0, 20, 40, 60, 60, 80, 100])})
    return query, hits


def test_spark_matches_bruteforce(spark):
    rng = random.Random(1234)
    cases = {qid: _random_case(rng, qid) for qid in range(300)}
    rows = [(qid, q, h["hit_pos"], h["id"], h["question"], h["score"], h["p"], h["r"])
            for qid, (q, hits) in cases.items() for h in hits]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in rerank(df, gate_scorer=lambda a, b: F.col("p"), rank_scorer=lambda a, b: F.col("r")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    mismatches = []
    for qid, (q, hits) in cases.items():
        want = rerank_one(q, hits)
        if sorted(got.get(qid, [])) != sorted(want):
            mismatches.append((qid, sorted(got.get(qid, [])), want))
    assert not mismatches, mismatches[:5]
    branches: dict = {}
    for q, hits in cases.values():
        rerank_one(q, hits, trace=branches)
    assert set(branches) == {"all", "dominant", "high"}, branches       # every gate branch exercised
