"""Train/validation split and reproducible shuffles by keyed hashing.

``exact_split`` gives the validation side exactly ``ceil(fraction * n)`` rows
(the count rule of the usual test-size split) without a global sort: a
65,536-bucket histogram of the hash finds the bucket that holds the k-th
smallest key, further hash bits refine it until it is small, only that is
ordered, and the k-th key becomes a single scalar threshold.  ``hash_split`` is the one-pass variant with the expected
size.  Neither reproduces a library's own permutation; both are stable under
re-partitioning and re-execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranqa.functions.keyed import DEFAULT_SEED, keyed_hash60
from ranqa.session import write_shared

VAL_FRACTION = 0.001     # fixed value equal to the reference's test size
_BUCKET_SHIFTS = (44, 28, 12, 0)   # 60-bit hash -> histograms of at most 2^16 buckets each
_SMALL_BUCKET = 10_000   # rows that may be ordered in one task


def split_key(keys: list[str], seed: int = DEFAULT_SEED) -> Column:
    return keyed_hash60(seed, F.lit("split"), *[F.col(k) for k in keys])


def shuffle_key(keys: list[str], seed: int = DEFAULT_SEED, salt: str = "shuffle") -> Column:
    return keyed_hash60(seed, F.lit(salt), *[F.col(k) for k in keys])


def val_count(n: int, fraction: float = VAL_FRACTION) -> int:
    return int(math.ceil(fraction * n))


def exact_split(df: DataFrame, keys: list[str], *, fraction: float = VAL_FRACTION,
                seed: int = DEFAULT_SEED, out_col: str = "split", materialize: bool = False) -> DataFrame:
    """Label rows ``'val'`` (the ``ceil(fraction*n)`` smallest split keys) or ``'train'``.

    Only the key columns and their hash are written to the checkpoint folder
    (a column-pruned pass over the input); the count, the histogram and the
    k-th key read that narrow copy, and the input itself is read once more
    to attach the label, so a stored table is never copied.  For an
    expensive derived input pass ``materialize=True``: it is then written
    once to the checkpoint folder and every pass reads that copy.  The input
    must be deterministic (a table, or keyed generation).
    """
    if materialize:
        base = write_shared(df.withColumn("_h", split_key(keys, seed)))   # one full copy
        narrow = base.select(*keys, "_h")
    else:
        base = df.withColumn("_h", split_key(keys, seed))                # re-read at the end
        narrow = write_shared(df.select(*keys).withColumn("_h", split_key(keys, seed)))
    rest, rem = narrow, None
    for shift in _BUCKET_SHIFTS:   # the bucket that holds the k-th key, refined until it is small
        hist = sorted((r["_b"], r["n"]) for r in
                      rest.groupBy(F.shiftright(F.col("_h"), shift).alias("_b"))
                      .agg(F.count(F.lit(1)).alias("n")).collect())
        if rem is None:
            rem = val_count(sum(c for _, c in hist), fraction)
            if rem == 0:
                return df.withColumn(out_col, F.lit("train"))
        for b, c in hist:
            if rem <= c:
                break
            rem -= c
        rest = rest.where(F.shiftright(F.col("_h"), shift) == b)
        if c <= _SMALL_BUCKET:
            break
    order = [F.col("_h")] + [F.col(c) for c in keys]
    kth = (rest.select(F.struct(*order).alias("_s"))
           .orderBy("_s").limit(rem).agg(F.max("_s").alias("_t")).collect()[0]["_t"])
    types = {f.name: f.dataType for f in narrow.schema.fields}
    names = ["_h", *keys]
    threshold = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(names, kth)])
    return (base.withColumn(out_col, F.when(F.struct(*order) <= threshold, F.lit("val"))
                            .otherwise(F.lit("train")))
            .drop("_h"))


def hash_split(df: DataFrame, keys: list[str], *, fraction: float = VAL_FRACTION,
               seed: int = DEFAULT_SEED, out_col: str = "split") -> DataFrame:
    """One pass: ``'val'`` when the 60-bit split key falls below ``fraction * 2^60``."""
    cut = int(fraction * (1 << 60))
    return df.withColumn(out_col, F.when(split_key(keys, seed) < F.lit(cut), F.lit("val"))
                         .otherwise(F.lit("train")))


def keyed_shuffle(df: DataFrame, keys: list[str], *, seed: int = DEFAULT_SEED,
                  partition_cols: list[str] | None = None, salt: str = "shuffle") -> DataFrame:
    """Deterministic random order: a global range-partitioned sort on a keyed hash."""
    out = df.withColumn("shuffle_key", shuffle_key(keys, seed, salt))
    return out.orderBy(*(partition_cols or []), "shuffle_key", *keys)


def finetune_split(qa: DataFrame, keys: list[str], *, fraction: float = VAL_FRACTION,
                   seed: int = DEFAULT_SEED, exact: bool = True, materialize: bool = False) -> DataFrame:
    """Q/A rows -> ``split, query, response, shuffle_key`` ordered for export."""
    if exact:
        labelled = exact_split(qa, keys, fraction=fraction, seed=seed, materialize=materialize)
    else:
        labelled = hash_split(qa, keys, fraction=fraction, seed=seed)
    renamed = labelled.select(*keys, "split", F.col("Q").alias("query"), F.col("A").alias("response"))
    return keyed_shuffle(renamed, keys, seed=seed, partition_cols=["split"])
