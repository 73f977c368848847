import random

import numpy as np
import pytest

from ranqa.operators.encoder import encode, fit_encoder


def test_misspelled_names_find_their_original(spark):
    rnd = random.Random(3)
    words = ["small", "large", "red", "blue", "ring", "widget", "bolt", "gear", "云手机", "套餐", "宽带", "golden", "steel", "办理"]
    names = sorted({" ".join(rnd.sample(words, 3)) for _ in range(120)})
    model = fit_encoder(spark.createDataFrame([(n,) for n in names], "name string"), dimensions=40)

    def typo(n):
        i = rnd.randrange(len(n) - 1)
        return n[:i] + n[i + 1] + n[i] + n[i + 2:]

    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(names)] + [(i, 1, typo(n)) for i, n in enumerate(names)],
                               "id int, kind int, name string")
    rows = encode(df, model).collect()
    x = {k: np.array([r.embedding for r in sorted(rows) if r.kind == k]) for k in (0, 1)}
    assert x[0].shape == (len(names), 40) and np.allclose(np.linalg.norm(x[0], axis=1), 1, atol=1e-5)
    hit = ((x[1] @ x[0].T).argmax(axis=1) == np.arange(len(names))).mean()
    print("typos that find their name", hit)
    assert hit >= 0.9


def test_null_empty_and_clashing(spark):
    texts = spark.createDataFrame([("a b",), ("b c",), ("c d e",), (None,)], "name string")
    model = fit_encoder(texts, dimensions=2)
    got = encode(spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "a b", "old")], "id int, name string, embedding string"),
                 model).collect()
    assert [r.embedding is None for r in sorted(got, key=lambda r: r.id)] == [True, False, False] and len(got[2].embedding) == 2
    with pytest.raises(ValueError):
        encode(texts.withColumnRenamed("name", "counts"), model, "counts")


def test_encoder_from_outside(spark):
    from ranqa.operators.retrieval import encode_texts

    def factory():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], np.float32)

    df = spark.createDataFrame([(i, None if i == 3 else "a" * i) for i in range(7)], "id int, name string").repartition(3)
    got = {r.id: r.embedding for r in encode_texts(df, factory, batch_size=2).collect()}
    assert got == {i: None if i == 3 else [float(i), float(i)] for i in range(7)}
