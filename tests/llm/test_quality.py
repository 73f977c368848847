import numpy as np
from pyspark.sql import functions as F

from ranqa.llm import quality as Q
from ranqa.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learn = labels.where("doc_id % 2 = 0")
    test = labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    scored = Q.score(docs, Q.fit(docs, learn, max_labelled=1500, max_pool=1500)).join(test, "doc_id")
    r = {x.quality: x.k for x in scored.groupBy("quality").agg(
        F.avg((F.col("p_quality") >= Q.THRESHOLD).cast("int")).alias("k")).collect()}
    assert r[1] > 0.99 and r[0] < 0.05


def test_co_training_helps_the_weak_view():
    rnd = np.random.default_rng(1)

    def views(n):
        y = (rnd.random(n) < 0.6).astype(float)
        return y, [(y[:, None] + rnd.normal(0, 0.4, (n, 10))).astype(np.float32),
                   (y[:, None] * 0.7 + rnd.normal(0, 1, (n, 10))).astype(np.float32)]

    y, x = views(40)
    _, pool = views(2000)
    truth, test = views(3000)
    alone = Q.fit_logistic(x[1][:30], y[:30])
    model = Q.co_train(x, y, pool)
    before = np.mean((Q.logit(test[1], alone) > 0) == truth)
    after = np.mean((Q.logit(test[1], model.metadata) > 0) == truth)
    assert after >= before
    assert np.mean((model.score(*test)[2] >= 0.5) == truth) > 0.95


def test_edge_cases(spark):
    rows = [(i, "good plain words here, all of them. " * 5 if i % 2 else "###$$ %% " * 20, "en", "s", 1.0) for i in range(60)]
    rows += [(100, None, None, None, 1.0), (101, "", "en", "s", 1.0), (101, "", "en", "s", 1.0), (None, "x", "fr", "s", 1.0),
             (102, "words " * 200_000, "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p_quality double")
    label = spark.createDataFrame([(i, i % 2 if i < 40 else None) for i in range(60)] + [(0, 0), (None, 1), (3, 0)],
                                  "doc_id long, quality int")
    model = Q.fit(docs, label)
    out = Q.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.p_quality <= 1 for r in out)
    got = {r.doc_id: r.p_quality >= Q.THRESHOLD for r in out}
    assert all(got[i] == bool(i % 2) for i in range(40, 60))
    assert Q.score(docs.limit(0), model).count() == 0
    for few in (label.limit(0), label.where("quality = 1")):
        assert Q.fit(docs, few) is None
        assert {r.p_quality for r in Q.score(docs, None).collect()} == {1.0}
    one = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, one)).count() == len(rows)
