"""Native (JVM-side, codegen'd) scoring expressions: length penalty, min-max, edit ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the length penalty (must equal the reference's):
# slow decay rate 0.005 up to a length difference of 20 (the knee),
# fast decay rate 2 beyond it, penalty capped at 0.5.
PENALTY_K_SLOW = 0.005
PENALTY_K_FAST = 2.0
PENALTY_KNEE = 20
PENALTY_CAP = 0.5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length_penalty(len_a, len_b, k_slow: float = PENALTY_K_SLOW, k_fast: float = PENALTY_K_FAST,
                   knee: int = PENALTY_KNEE, cap: float = PENALTY_CAP) -> Column:
    """Multiplier in [1-cap, 1] for two text lengths (code points).

    ``d <= knee``: ``exp(-k_slow*d)``; beyond: ``1 - min(1-exp(-k_fast*(d-knee)), cap)``.
    """
    d = F.abs(_col(len_a) - _col(len_b))
    factor = (F.when(d <= F.lit(knee), F.lit(1.0) - F.exp(F.lit(-k_slow) * d))
              .otherwise(F.lit(1.0) - F.exp(F.lit(-k_fast) * (d - F.lit(knee)))))
    return F.lit(1.0) - F.greatest(F.lit(0.0), F.least(factor, F.lit(cap)))


def text_length_penalty(a, b, **kw) -> Column:
    return length_penalty(F.char_length(_col(a)), F.char_length(_col(b)), **kw)


def minmax(x, lo, hi) -> Column:
    """``(x-lo)/(hi-lo)``, 1.0 when the range collapses (no division is evaluated then)."""
    x, lo, hi = _col(x), _col(lo), _col(hi)
    return F.when(hi == lo, F.lit(1.0)).otherwise((x - lo) / F.when(hi != lo, hi - lo))


def lev_ratio(a, b) -> Column:
    """Integer 0..100 similarity ``round(100*(L-d)/L)``, L the longer length.

    Native and codegen'd, so it is the default scorer in both re-rank slots.
    Two empty strings score 100; a null side gives null.
    """
    a, b = _col(a), _col(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    dist = F.levenshtein(a, b)
    return (F.when(longest == 0, F.lit(100))
            .otherwise(F.round(F.lit(100.0) * (longest - dist) / longest))
            .cast("int"))


def entropy_term(x, epsilon: float = 1e-10) -> Column:
    """One summand of the spread statistic ``-sum(s*ln(s+epsilon))``."""
    x = _col(x)
    return -(x * F.log(x + F.lit(epsilon)))
