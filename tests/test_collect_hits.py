import datetime
import os
import random
import tempfile

from pyspark.sql import functions as F

from ranqa.operators.rerank import rerank
from ranqa.streaming.collect_hits import _milliseconds, rerank_collected

SCHEMA = "query_id long, query_text string, hit_pos long, id long, question string, score double, note string, asked_at timestamp, arrived_at timestamp"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def hits(n_queries, per_query):
    rnd = random.Random(5)
    words = ["small", "ring", "red", "widget", "blue", "bolt"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(3))
    out = []
    for q in range(n_queries):
        query = text()
        for p in range(per_query if q else 5 * per_query):  # query 0 holds most hits
            out.append((q, query, p, 1000 * q + p, text() if p % 7 else None, round(rnd.uniform(0, 100), 3), None if p % 3 else "n", q))
    return out


def test_equal_to_batch_over_restarts_and_late_hits_aside(spark):
    d = tempfile.mkdtemp(prefix="ranqa-collect-")
    src, out, late, cp = (os.path.join(d, x) for x in ("in", "out", "late", "cp"))
    rows = hits(6, 20)
    rnd = random.Random(6)
    rnd.shuffle(rows)

    def send(part, arrived):
        spark.createDataFrame([(*r[:-1], at(r[-1]), at(arrived)) for r in part], SCHEMA).write.mode("append").parquet(src)

    def run():  # every call is a restart from the checkpoint
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        rerank_collected(stream, out, late, cp, wait="30 seconds", salts=3).awaitTermination()

    def answered():
        files = os.path.exists(out) and any(f.startswith("epoch=") for f in os.listdir(out))
        return spark.read.parquet(out) if files else None

    a, b, c = rows[:70], rows[70:130], rows[130:]
    send(a, 6)
    run()
    send(b, 12)
    run()
    assert answered() is None or answered().count() == 0  # no deadline has passed
    send(c, 20)
    run()
    tick = (99, "clock", 0, 99_000, None, 0.0, None)
    send([(*tick, 1000)], 40)  # the watermark passes the deadlines of all six
    run()
    send([(2, rows[0][1], 777, 2777, "small ring", 99.0, "late", 2), (3, "x", 778, 3778, None, 5.0, None, 3)], 41)
    run()
    send([(*tick, 1000)], 45)
    run()
    batch = spark.createDataFrame([(*r[:-1], at(r[-1]), at(0)) for r in rows], SCHEMA).drop("asked_at", "arrived_at")
    want = rerank(batch)
    cols = [c for c in want.columns]
    got = answered().select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    assert answered().select("epoch").distinct().count() == 1  # all salts in one micro-batch
    assert sorted(r.id for r in spark.read.parquet(late).collect()) == [2777, 3778]


def test_intervals():
    assert [_milliseconds(x) for x in ("30 seconds", "1 minute", "2 hours", "5 milliseconds")] == [30_000, 60_000, 7_200_000, 5]


def test_expressions_follow_the_schema(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert df.select(F.unix_millis("asked_at")).schema[0].dataType.simpleString() == "bigint"
