import os
import tempfile

from ranqa.operators.rerank import rerank
from ranqa.streaming.rerank_stream import rerank_stream, tag_stream

from conftest import SF_SMALL


def test_rerank_stream_matches_batch(spark):
    from ranqa.plans.fixtures import brand_hits

    hits = brand_hits(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="ranqa-stream-")
    src = os.path.join(d, "hits")
    hits.repartition(3, "query_id").write.parquet(src)
    stream = spark.readStream.schema(hits.schema).parquet(src)
    q = rerank_stream(stream, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(d, "out")).select("query_id", "id", "rank").collect()
    want = rerank(spark.read.parquet(src)).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_tag_stream(spark):
    d = tempfile.mkdtemp(prefix="ranqa-stream-")
    spark.createDataFrame([("资费标准",), ("活动规则",)], "text string").write.parquet(os.path.join(d, "in"))
    s = spark.readStream.schema("text string").parquet(os.path.join(d, "in"))
    q = (tag_stream(s).writeStream.format("memory").queryName("tagged_test")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = sorted(r["labels"] for r in spark.sql("SELECT labels FROM tagged_test").collect())
    assert rows == ["产品资费", "活动规则"]
