"""Substring and token scorers as Column expressions over the edit ratio.

``window_ratio`` is the best edit ratio of the shorter text against every
window of its length in the longer one; ``weighted_ratio`` is a weighted
maximum of the plain, sorted-token and shared-token edit ratios of the
cleaned texts, windowed when the lengths differ much.  Scores are integers
0..100; a null side gives null.  No Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranqa.functions.scoring import lev_ratio

SIGNS = r"[^\p{L}\p{N}]+"                 # what cleaning turns into one space
TOKEN_WEIGHT, FAR, VERY_FAR = 0.95, 0.9, 0.6
SIMILAR_LENGTH, VERY_DIFFERENT_LENGTH = 1.5, 8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def window_ratio(a, b) -> Column:
    """Best edit ratio of the shorter text within the longer one (either order)."""
    a, b = _col(a), _col(b)
    first = F.char_length(a) <= F.char_length(b)
    pair = F.struct(F.when(first, a).otherwise(b).alias("s"), F.when(first, b).otherwise(a).alias("l"))

    def best(p: Column) -> Column:
        n = F.char_length(p["s"])
        starts = F.sequence(F.lit(1), F.char_length(p["l"]) - n + 1)
        found = F.array_max(F.transform(starts, lambda i: lev_ratio(p["s"], F.substring(p["l"], i, n))))
        return F.when(n == 0, F.when(F.char_length(p["l"]) == 0, 100).otherwise(0)).otherwise(found)

    return F.when(a.isNotNull() & b.isNotNull(), _let(pair, best)).cast("int")


def clean(c) -> Column:
    """Lower case, letters and digits only, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), SIGNS, " "))


def token_forms(a: Column, b: Column) -> Column:
    """Struct of the cleaned texts' sorted tokens and their shared-token forms."""
    tok = lambda c: F.array_sort(F.split(c, " "))

    def forms(p: Column) -> Column:
        both = F.array_intersect(p["x"], p["y"])
        join = lambda *parts: F.array_join(F.concat(*parts), " ")
        return F.struct(join(p["x"]).alias("x"), join(p["y"]).alias("y"), join(both).alias("both"),
                        join(both, F.array_except(p["x"], p["y"])).alias("left"),
                        join(both, F.array_except(p["y"], p["x"])).alias("right"))

    return _let(F.struct(tok(a).alias("x"), tok(b).alias("y")), forms)


def weighted_ratio(a, b) -> Column:
    """Weighted maximum of the plain and the token-wise edit ratios of two cleaned texts."""
    a, b = _col(a), _col(b)

    def score(p: Column) -> Column:
        la, lb = F.char_length(p["a"]), F.char_length(p["b"])
        apart = F.greatest(la, lb) / F.least(la, lb)
        scale = F.when(apart > VERY_DIFFERENT_LENGTH, VERY_FAR).otherwise(FAR)

        def by_token(ratio: Callable) -> Column:
            return _let(token_forms(p["a"], p["b"]), lambda t: F.greatest(
                ratio(t["x"], t["y"]), ratio(t["both"], t["left"]), ratio(t["both"], t["right"]),
                ratio(t["left"], t["right"])))

        near = F.greatest(lev_ratio(p["a"], p["b"]).cast("double"), by_token(lev_ratio) * F.lit(TOKEN_WEIGHT))
        far = F.greatest(lev_ratio(p["a"], p["b"]).cast("double"), window_ratio(p["a"], p["b"]) * scale,
                         by_token(window_ratio) * F.lit(TOKEN_WEIGHT) * scale)
        return F.when(F.least(la, lb) == 0, F.lit(0)).when(apart < SIMILAR_LENGTH, F.round(near)).otherwise(F.round(far))

    both = F.struct(clean(a).alias("a"), clean(b).alias("b"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(both, score)).cast("int")
