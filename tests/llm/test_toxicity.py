import numpy as np
from pyspark.sql import functions as F

from ranqa.llm import toxicity as X
from ranqa.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = X.fit(docs, labels.where("doc_id % 2 = 0"))
    scored = X.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", "toxic"), "doc_id")
    # labels call some documents toxic that hold no toxic word at all; recall is taken on the others
    scored = scored.withColumn("plain", ~F.col("text").rlike("(?i)idiot|trash|scum|moron|loser|clown|stupid"))
    r = {(x.toxic, x.plain): x.f for x in scored.groupBy("toxic", "plain").agg(
        F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("f")).collect()}
    print("flagged: clean", r[0, True], "toxic with listed words", r[1, False], "toxic without", r.get((1, True)))
    assert r[0, True] < 0.01 and r[1, False] > 0.97
    assert np.all(np.diff(model.theta) > 0)


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(2)
    n, m = 2000, 5
    x = rnd.integers(0, 2, (n, m))
    w = np.array([2.0, 1.0, 0.0, -1.0, 0.5])
    z = x @ w + rnd.logistic(size=n)
    y = np.searchsorted([0.0, 2.0], z)
    rows, cols = np.nonzero(x)
    got, theta = X.fit_ordinal(rows, cols, np.ones(len(rows)), y, m, 3)
    assert np.abs(got - w).max() < 0.4 and np.abs(theta - [0.0, 2.0]).max() < 0.4


def test_edge_cases(spark):
    rows = [(i, f"some plain words {i} here" + (" vile nasty" * (1 + i % 3) if i % 2 else ""), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", "x"), (101, "", "x"), (None, "vile nasty vile nasty", "x"), (102, "ok " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0), (61, None), (None, 1), (70, 0), (70, 1)],
                                   "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert all((got[i].p_toxic >= 0.5) == bool(i % 2) for i in range(80)) and got[None].p_toxic > 0.5
    assert got[5].severity > got[0].severity and got[101].p_toxic < 0.5 and got[102].p_toxic < 0.5
    assert X.score(docs, model).count() == len(rows) and X.score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert X.fit(docs, few) is None
    assert {r.severity for r in X.score(docs, None).collect()} == {0.0}
