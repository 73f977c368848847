"""Catalog and line-file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranqa.session import bounded_broadcast, write_shared


def column_union(tables: list[DataFrame], column: str, out_col: str | None = None) -> DataFrame:
    """Bag union of one named column over several tables ("sheets").

    Tables without the column are skipped; duplicates are kept; nulls are
    dropped (they cannot be entity names).  No shuffle: a plain union.
    """
    out_col = out_col or column
    parts = [t.select(F.col(column).cast("string").alias(out_col)) for t in tables if column in t.columns]
    if not parts:
        raise ValueError(f"no table has a column named {column!r}")
    bag = parts[0]
    for p in parts[1:]:
        bag = bag.unionByName(p)
    return bag.where(F.col(out_col).isNotNull())


def distinct_catalog(tables: list[DataFrame], column: str, out_col: str = "name") -> DataFrame:
    return column_union(tables, column, out_col).distinct()


def read_lines(spark: SparkSession, path: str, *, id_col: str = "line_no", value_col: str = "value",
               file_col: str | None = None) -> DataFrame:
    """Text files as ``(line_no, value)``: line breaks (LF, CRLF, CR) stripped, blank lines kept, ``line_no`` dense from 0.

    A folder's files are numbered one after the other in the order of their paths; ``file_col`` adds the path.  A split
    of a file is read in order, so a line's number is its place in the split plus the lines of all splits before it by (path, byte
    offset): sums over one row per split, no sort and no shuffle of the lines (the splits' table is joined by broadcast
    up to a checked size).
    """
    # written once, so that the rows of a split keep their places
    raw = write_shared(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("_value")))
    splits = raw.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"),
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    numbered = raw.join(bounded_broadcast(offsets), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    file = [F.col("_file").alias(file_col)] if file_col else []
    return numbered.select(*file, (F.col("_mid") + F.col("_off")).alias(id_col), F.col("_value").alias(value_col))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template file -> ``template_id, template``."""
    return read_lines(spark, path).select(F.col("line_no").alias("template_id"),
                                          F.col("value").alias("template"))
