"""Reading integer coordinates out of a table of embeddings, for the operators that need exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, embedding: str, below: float, *more: str) -> DataFrame:
    """``vec_id, e, d`` (double entries and their number) and the columns ``more`` as ``more0 ..`` of the rows whose
    vector is there and holds only finite entries of absolute value under ``below``."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                          F.col(f"`{embedding}`").cast("array<double>").alias("e"),
                          *[F.col(f"`{c}`").alias(f"more{i}") for i, c in enumerate(more)])
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < below))
    return rows.where(F.col("e").isNotNull() & fine).withColumn("d", F.size("e"))


def lengths(rows: DataFrame) -> dict[int, int]:
    """Rows by vector length: one number per length in the table."""
    return {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()}


def floors(vectors: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * entry)`` as long, one row per vector; all vectors have one length of at least 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).astype(np.int64).reshape(len(vectors), -1)
