"""Structured Streaming entry points.

The re-ranker's windows are per query, not per time, so on a stream it runs
inside ``foreachBatch``: every micro-batch is a batch DataFrame of complete
hit lists (all hits of a query must arrive in the same micro-batch, which is
how a search service emits them).  Output is written per epoch with dynamic
partition overwrite, so a retried epoch replaces its own output instead of
duplicating it.  Keyword tagging is stateless and runs directly on the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranqa.operators.rerank import rerank
from ranqa.operators.tagger import DEFAULT_LEXICON, Lexicon, tag_string


def rerank_stream(hits: DataFrame, output_path: str, checkpoint_location: str, *,
                  trigger: dict | None = None, **rerank_kw) -> StreamingQuery:
    """Start a query that re-ranks each micro-batch of hits into parquet
    partitioned by ``epoch``."""

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        out = rerank(batch, **rerank_kw).withColumn("epoch", F.lit(epoch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(output_path))

    w = hits.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def tag_stream(texts: DataFrame, text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON,
               out_col: str = "labels") -> DataFrame:
    """Stateless keyword tagging on a streaming (or batch) DataFrame."""
    return texts.withColumn(out_col, tag_string(F.col(text_col), lexicon))
