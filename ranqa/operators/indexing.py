"""Dense 0..n-1 positions for a dimension: every row gets exactly one, repeated keys included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.session import write_shared

# Rows that may be ordered in one task; a table is counted up to this bound first.
SMALL_ROWS = 20_000


def dense_index_counted(df: DataFrame, order_cols: list[str], out_col: str = "idx",
                        small_rows: int = SMALL_ROWS) -> tuple[DataFrame, int]:
    """``dense_index`` plus the row count."""
    n = df.limit(small_rows + 1).count()
    if n <= small_rows:
        return _in_one_task(df, order_cols, out_col), n
    return _by_ranges(df, order_cols, out_col, None)


def dense_index(df: DataFrame, order_cols: list[str], out_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Attach ``out_col`` = position of each row in ``order_cols`` order (0-based).

    Rows with equal keys follow each other in the order of a hash of the whole row (equal rows are
    interchangeable), so the position does not depend on the partitioning.  A table of at most ``SMALL_ROWS`` rows is
    ordered in one task.  Otherwise, when the keys are unique, only they are range-partitioned and sorted and the
    positions are joined back; when keys repeat, whole rows are dealt by (key, hash, row id), which splits a
    key that holds any share of the rows over several ranges.  Only the counts, one row per partition, meet in one place.
    """
    if num_partitions is None:
        return dense_index_counted(df, order_cols, out_col)[0]
    return _by_ranges(df, order_cols, out_col, num_partitions)[0]


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def _in_one_task(df: DataFrame, order_cols: list[str], out_col: str) -> DataFrame:
    order = Window.orderBy(*order_cols, _row_hash(df))
    return df.withColumn(out_col, (F.row_number().over(order) - 1).cast("bigint"))


def _dealt(df: DataFrame, order: list[str], num_partitions: int | None, out_col: str) -> DataFrame:
    """``df`` written in ``order`` with its position."""
    dealt = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    pid = F.spark_partition_id()
    tagged = write_shared(dealt.sortWithinPartitions(*order).withColumn("_pid", pid).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")   # one row per partition
            .withColumn(out_col, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off"))


def _by_ranges(df: DataFrame, order_cols: list[str], out_col: str, num_partitions: int | None) -> tuple[DataFrame, int]:
    idx = _dealt(df.select(*order_cols), order_cols, num_partitions, out_col)
    n = idx.count()
    repeated = idx.groupBy(*order_cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.limit(1).count() == 0:
        named = idx.select(out_col, *[F.col(c).alias(f"_key{i}") for i, c in enumerate(order_cols)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(order_cols)])
        return df.join(named, same).drop(*[f"_key{i}" for i in range(len(order_cols))]), n
    # the row id is written, so that it is fixed for the passes of the range partitioning
    rows = write_shared(df.withColumn("_hash", _row_hash(df)).withColumn("_row", F.monotonically_increasing_id()))
    return _dealt(rows, [*order_cols, "_hash", "_row"], num_partitions, out_col).drop("_hash", "_row"), n
