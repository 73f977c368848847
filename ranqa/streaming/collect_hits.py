"""Re-rank of hits that arrive over several micro-batches.

A search service may send a query's hits in several messages.  Hits are kept in state until the query's deadline
(``asked_at`` plus ``wait``) lies behind the watermark of their arrival times; then all of them are handed on at once, re-ranked with the
batch operator, and their state is gone.  A hit whose query is past its deadline is late: it changes nothing any more and goes
to a table of its own.

State is keyed by (query, salt of the hit), so that a query with a large share of all hits is spread over tasks; the salts share
the deadline and the watermark, so they are released in one micro-batch.  Output is written per epoch with dynamic partition
overwrite: a repeated epoch replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ranqa.operators.rerank import rerank

SALTS = 8
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HitCollector(StatefulProcessor):
    """Holds the hits of one (query, salt) until the deadline."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        names = self.schema.fieldNames()
        deadlines = set()
        for pdf in rows:
            deadline = pdf["deadline"].astype("int64")
            for d, part in pdf.groupby(deadline):
                values = part[names].astype(object).where(part[names].notna(), None)
                if d <= now:
                    yield values.assign(late=True)
                else:
                    self.hits.appendList([tuple(v) for v in values.itertuples(index=False)])
                    deadlines.add(int(d))
        for d in deadlines:
            self.handle.registerTimer(d)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rows = list(self.hits.get())
        self.hits.clear()
        if rows:
            yield pd.DataFrame(rows, columns=self.schema.fieldNames(), dtype=object).assign(late=False)

    def close(self) -> None:
        pass


def collect_hits(hits: DataFrame, *, wait: str = "30 seconds", asked_at: str = "asked_at", arrived_at: str = "arrived_at",
                 delay: str = "0 seconds", salts: int = SALTS) -> DataFrame:
    """The streaming hits again, each once its query is complete, plus ``late``.

    ``hits`` holds the columns of the re-ranker, the query's ``asked_at`` and the hit's ``arrived_at`` (timestamps); the watermark
    is the latest arrival less ``delay``.
    """
    spark = hits.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)  # the only one that holds timers
    kept = T.StructType([f for f in hits.schema.fields if f.name not in (asked_at, arrived_at)])
    wait_ms = _milliseconds(wait)
    marked = (hits.withWatermark(arrived_at, delay)
              .withColumn("deadline", F.unix_millis(asked_at) + F.lit(wait_ms))
              .withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(salts)).cast("int")))
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept.fields], T.StructField("late", T.BooleanType())])
    return marked.groupBy("query_id", "salt").transformWithStateInPandas(
        HitCollector(kept), out, "Append", "EventTime")


_UNITS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(interval: str) -> int:
    """"30 seconds" -> 30000."""
    number, unit = interval.split()
    return int(float(number) * _UNITS[unit.rstrip("s")])


def rerank_collected(hits: DataFrame, output_path: str, late_path: str, checkpoint_location: str, *, wait: str = "30 seconds",
                     delay: str = "0 seconds", salts: int = SALTS, trigger: dict | None = None, **rerank_kw) -> StreamingQuery:
    """Start a query that re-ranks each query once its hits are complete; results and late hits are Parquet tables by ``epoch``."""

    def per_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for rows, path in ((rerank(batch.where("not late").drop("late"), **rerank_kw), output_path),
                               (batch.where("late").drop("late"), late_path)):
                (rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("epoch").parquet(path))
        finally:
            batch.unpersist()

    collected = collect_hits(hits, wait=wait, delay=delay, salts=salts)
    w = collected.writeStream.foreachBatch(per_batch).outputMode("append").option("checkpointLocation", checkpoint_location)
    return w.trigger(**(trigger or {"availableNow": True})).start()
