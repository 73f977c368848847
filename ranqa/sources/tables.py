"""Table scans.  Parquet first: column pruning and filter pushdown come for free."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one named table (``<sf_dir>/<name>.parquet``; a directory also works)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read parquet / orc / json / csv / text by extension or explicit format."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    fmt = {"jsonl": "json", "txt": "text"}.get(fmt, fmt)
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return reader.format(fmt).load(path)
