"""Sinks: JSON Lines exports and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """One JSON object per line, UTF-8, non-ASCII unescaped, null fields written.

    Row order inside the output follows ``df``'s order (sort first for a
    shuffled export); each task writes its own part file, no single writer.
    """
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_splits(split_df: DataFrame, path: str, cols: tuple[str, ...] = ("query", "response")) -> None:
    """``<path>/split=train`` and ``<path>/split=val`` JSONL folders in one write."""
    write_jsonl(split_df.select("split", *cols), path, partition_by=["split"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a given schema (no inference pass); a line that does not fit it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_index(index: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Persist ``(id, name, embedding)`` as parquet (the vector + text index)."""
    index.write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
