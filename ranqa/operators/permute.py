"""Shuffling without a sort of the whole table: a keyed bijection of 0..n-1 gives every row its place.

``permuted`` is column arithmetic (rounds of "swap or not": a round pairs each number with its mirror at a keyed
point and swaps the pair or leaves it by a keyed bit of the larger one), so a row's place depends on its number, ``n`` and the seed only.
``in_permuted_order`` sends rows to their part of 0..n-1 and orders each part: the parts are known beforehand, so
no sampling pass reads the input a second time and rows move once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranqa.functions.keyed import DEFAULT_SEED

ROUNDS = 24
PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """(mirror point, two factors, summand) of every round."""
    out = []
    for r in range(rounds):
        d = hashlib.sha256(f"{seed}|permute|{r}".encode()).digest()
        part = lambda i, m: int.from_bytes(d[8 * i:8 * i + 8], "big") % m
        out.append((part(0, 1 << 62), 1 + part(1, PRIME - 1), 1 + part(2, PRIME - 1), part(3, PRIME)))
    return out


def permuted(i, n, seed: int = DEFAULT_SEED, rounds: int = ROUNDS) -> Column:
    """The place of row number ``i`` (0 <= i < n): a bijection of 0..n-1 for every ``n`` from 1 on."""
    i, n = ((c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)).cast("long") for c in (i, n))
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("kacb", key)]) for key in round_keys(seed, rounds)])

    def step(x: Column, key: Column) -> Column:
        mirror = F.pmod(F.pmod(key["k"], n) - x, n)
        larger = F.greatest(x, mirror)
        high = F.shiftright(larger, 31)
        bit = F.pmod(F.pmod(F.pmod(larger, F.lit(PRIME)) * key["a"] + F.pmod(high, F.lit(PRIME)) * key["c"] + key["b"],
                            F.lit(PRIME)), F.lit(2))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(keys, i, step)


def in_permuted_order(df: DataFrame, place: str, n: int, partitions: int) -> DataFrame:
    """Rows in the order of ``place`` (0..n-1, gaps allowed): partition after partition, ordered inside each."""
    each = max(1, -(-n // partitions))
    part = F.expr(f"cast(`{place}` div {each} as int)")
    return df.repartitionById(partitions, part).sortWithinPartitions(place)
