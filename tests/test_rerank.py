import pytest
from pyspark.sql import functions as F

from ranqa.operators.rerank import entropy_gate, rerank, rerank_stages

HAND = [  # FIXTURES.md §3 hand-worked example: (hit_pos, id, question, score, partial, rank)
    (1, 1, "aaaaa", 40.0, 90, 80),
    (2, 2, "bbbbb", 30.0, 60, 100),
    (3, 3, "ccccc", 20.0, 40, 60),
    (4, 4, "ddddd", 10.0, 100, 40),
]
SCHEMA = "query_id bigint, query_text string, hit_pos bigint, id bigint, question string, score double, p int, r int"


def _hits(spark, rows, qid=1):
    return spark.createDataFrame([(qid, "qqqqq", *r) for r in rows], SCHEMA)


def _injected(**kw):
    return dict(gate_scorer=lambda a, b: F.col("p"), rank_scorer=lambda a, b: F.col("r"), **kw)


def test_hand_worked(spark):
    st = rerank_stages(_hits(spark, HAND), **_injected())
    cos = {r["id"]: (r["cos_norm"], r["cos_contrib"]) for r in st.cosine.collect()}
    assert cos == {1: (1.0, 1.0), 2: (0.5, 0.5), 3: (0.0, None)}
    fz = {r["id"]: r["fuz_score"] for r in st.fuzzy.collect()}
    assert fz[1] == pytest.approx(2 / 3) and fz[2] == 1.0 and fz[3] == pytest.approx(1 / 3) and fz[4] == 0.0
    out = st.result.orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["branch"]) for r in out] == [(1, 1, "all"), (2, 2, "all")]
    assert out[0]["total"] == pytest.approx(5 / 3) and out[1]["total"] == pytest.approx(1.5)


def test_all_scores_low_gives_nothing(spark):
    low = [(p, i, q, 10.0, a, b) for p, i, q, _, a, b in HAND]
    assert rerank(_hits(spark, low), **_injected()).count() == 0


def test_row_alignment_when_low_hit_first(spark):
    moved = [HAND[3]] + HAND[:3]
    moved = [(pos + 1, *r[1:]) for pos, r in enumerate(moved)]
    out = rerank(_hits(spark, moved), **_injected()).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 2]


def test_hits_without_question_ignored_and_payload_kept(spark):
    rows = HAND + [(5, 5, None, 99.0, 100, 100)]
    df = _hits(spark, rows).withColumn("payload", F.concat(F.lit("p"), F.col("id").cast("string")))
    out = rerank(df, **_injected()).orderBy("rank").collect()
    assert [r["payload"] for r in out] == ["p1", "p2"]


def test_duplicate_text_sums_and_returns_last_id(spark):
    rows = [(1, 1, "aaaaa", 40.0, 90, 80), (2, 2, "aaaaa", 30.0, 60, 100), (3, 3, "ccccc", 20.0, 40, 60)]
    out = rerank(_hits(spark, rows), **_injected()).collect()
    assert [r["id"] for r in out] == [2]        # one text, last id wins
    # cosine 1.0 + 0.5; fuzzy 1.0 (the other copy sits at exactly 0.5, not > 0.5)
    assert out[0]["total"] == pytest.approx(1.0 + 0.5 + 1.0)


def test_independent_of_partitioning(spark):
    big = []
    for q in range(30):
        for i in range(12):
            big.append((q, f"q{q:03d}", i, q * 100 + i, f"t{(q * 7 + i * 3) % 9}", float((i * 37 + q) % 60), 0, 0))
    df = spark.createDataFrame(big, SCHEMA)
    a = sorted(map(tuple, rerank(df).select("query_id", "id", "rank").collect()))
    b = sorted(map(tuple, rerank(df.repartition(7).orderBy(F.rand(3))).select("query_id", "id", "rank").collect()))
    assert a == b and a


GATE = [  # totals, flag, branch, kept ranks, H (FIXTURES.md §3)
    ([1.0], False, "all", [1], -1e-10),
    ([1.6666667, 1.5], False, "all", [1, 2], -1e-10),
    ([1.2, 1.2, 1.2], False, "all", [1, 2, 3], -3e-10),
    ([1.9, 1.5, 0.95], False, "all", [1, 2, 3], 0.316420),
    ([2.0, 1.55, 0.8], False, "high", [1, 2], 0.293752),
    ([2.0, 1.55, 0.8], True, "dominant", [1], 0.293752),
    ([1.9, 1.42, 1.3, 1.18, 0.7], False, "dominant", [1], 1.019585),
    ([1.7, 1.65, 1.1, 1.04, 0.7], False, "high", [1, 2], 0.782040),
]


def test_entropy_gate_golden(spark):
    merged, flags = [], []
    for q, (totals, flag, *_rest) in enumerate(GATE):
        flags.append((q, flag))
        merged += [(q, f"t{i}", t, i + 1) for i, t in enumerate(totals)]
    m = spark.createDataFrame(merged, "query_id bigint, question string, total double, first_seq int")
    f = spark.createDataFrame(flags, "query_id bigint, flag boolean")
    g = entropy_gate(m, f).collect()
    for q, (_t, _f, branch, kept, h) in enumerate(GATE):
        rows = [r for r in g if r["query_id"] == q]
        assert {r["branch"] for r in rows} == {branch}, q
        assert sorted(r["merged_rank"] for r in rows if r["keep"]) == kept, q
        assert rows[0]["h"] == pytest.approx(h, abs=1e-6), q


def test_dedupe_ids_keeps_last(spark):
    rows = [(1, 7, "aaaaa", 40.0, 90, 80), (2, 8, "bbbbb", 30.0, 60, 100), (3, 7, "ccccc", 20.0, 40, 60)]
    from ranqa.operators.rerank import dedupe_hits
    d = dedupe_hits(_hits(spark, rows)).collect()
    assert sorted((r["id"], r["question"]) for r in d) == [(7, "ccccc"), (8, "bbbbb")]
    out = rerank(_hits(spark, rows), dedupe_ids=True, **_injected()).collect()
    assert {r["id"] for r in out} <= {7, 8}


def test_observed_rerank(spark):
    from ranqa.operators.rerank import observed_rerank
    out, obs = observed_rerank(_hits(spark, HAND), **_injected())
    rows = out.collect()
    m = obs.get
    assert m["kept_rows"] == len(rows) == 2 and m["rows_all"] == 2 and m["queries_answered"] == 1


def test_attach_queries(spark):
    from ranqa.operators.rerank import attach_queries
    hits = _hits(spark, HAND).drop("query_text")
    queries = spark.createDataFrame([(1, "qqqqq"), (2, "other")], "query_id bigint, query_text string")
    out = rerank(attach_queries(hits, queries), **_injected()).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 2] and out[0]["query_text"] == "qqqqq"
    salted = rerank(attach_queries(hits, queries, salt=4), **_injected()).orderBy("rank").collect()
    assert [tuple(r) for r in salted] == [tuple(r) for r in out]


def test_preview_trace(spark):
    from ranqa.operators.rerank import preview_trace, rerank_trace
    rows = [(p, 100 + p, f"t{p % 3}", float(20 + p), 60, 50) for p in range(1, 15)]
    t = rerank_trace(_hits(spark, rows), **_injected())
    prev = preview_trace(t, n=10).collect()
    assert sorted(r["hit_pos"] for r in prev) == list(range(1, 11))
