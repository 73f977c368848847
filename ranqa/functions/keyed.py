"""Reproducible keyed pseudo-randomness.

Every random draw is a pure function of ``(seed, key parts)``: the first 8 hex
digits of ``md5("seed|part|part...")`` read as a non-negative integer.  The
same value comes out of any engine with md5 and hex parsing (DuckDB:
``('0x'||substr(md5(k),1,8))::BIGINT``), it does not depend on partitioning or
row order, and a re-executed task draws exactly the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def key_string(seed: int, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def keyed_hash32(seed: int, *parts) -> Column:
    """Non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(key_string(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def keyed_hash60(seed: int, *parts) -> Column:
    """Non-negative bigint in [0, 2^60): order key for shuffles and splits."""
    return F.conv(F.substring(F.md5(key_string(seed, *parts)), 1, 15), 16, 10).cast("bigint")


def keyed_choice_index(n, seed: int, *parts) -> Column:
    """Uniform index in [0, n) (with replacement across keys)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(keyed_hash32(seed, *parts), n)


def keyed_randint(lo: int, hi: int, seed: int, *parts) -> Column:
    """Uniform integer in [lo, hi], both ends inclusive."""
    return F.lit(lo) + F.pmod(keyed_hash32(seed, *parts), F.lit(hi - lo + 1))


def keyed_digest(seed: int, *parts) -> Column:
    """The md5 hex digest of the key: 32 hex digits = four independent
    32-bit draws (slices 0..3) from one hash evaluation."""
    return F.md5(key_string(seed, *parts))


def digest_slice(digest: Column, i: int) -> Column:
    """Draw ``i`` (0..3) of a digest as a non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
