"""Similarity by longest matching blocks: plain, substring and weighted scores of two texts, 0..100.

The rules are those of the standard library's sequence matcher (its popular-character rule included), rounded half to even:

* ``ratio``: equal texts 100, otherwise twice the matched characters over both lengths; a null or empty side 0;
* ``partial_ratio``: the shorter text against the windows of its length that the matching blocks align, best one;
* ``weighted_ratio``: over cleaned texts the maximum of the plain ratio and the sorted-token and token-set ratios
  (substring forms when the lengths differ by half or more), each with its weight.

Batches of pairs are worked on together: texts of up to ``SHORT`` characters as arrays, where every search for the next
longest block runs over all open pieces of all pairs at once; longer ones pair by pair.  Repeated pairs of a batch are
scored once, and weighted forms that cannot win are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 64                      # characters up to which texts are compared as arrays
CELLS = 2_000_000               # entries of one array
TOKEN_WEIGHT, FAR, VERY_FAR = 0.95, 0.9, 0.6
SIMILAR_LENGTH, VERY_DIFFERENT_LENGTH = 1.5, 8
SAME = 0.995                    # a window above this counts as the whole


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int32)
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def matching_blocks(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """(pair, start in a, start in b, size) of all matching blocks of short texts, in no order."""
    la, lb = max(map(len, a), default=0), max(map(len, b), default=0)
    if not la or not lb:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    same = _codes(a, la, -1)[:, :, None] == _codes(b, lb, -2)[:, None, :]
    run = np.zeros((len(a), la + 1, lb + 1), np.int8)  # equal characters that end at a pair of places
    for i in range(la):
        run[:, i + 1, 1:] = np.where(same[:, i], run[:, i, :-1] + 1, 0)
    run = run[:, 1:, 1:]
    row, col = np.arange(la, dtype=np.int8)[None, :], np.arange(lb, dtype=np.int8)[None, :]
    size = lambda ts: np.array([len(t) for t in ts])
    # open pieces: pair, from and to in a, from and to in b
    todo = np.column_stack([np.arange(len(a)), np.zeros(len(a), np.int64), size(a), np.zeros(len(a), np.int64), size(b)])
    todo = todo[(todo[:, 2] > 0) & (todo[:, 4] > 0)]
    found = []
    step = max(1, CELLS // (la * lb))
    while len(todo):
        below = []
        for at in range(0, len(todo), step):
            p, a0, a1, b0, b1 = todo[at:at + step].T
            # runs are cut where the piece begins, and count only inside of it
            rows = np.where(row < a1[:, None], row - a0[:, None] + 1, 0).clip(0).astype(np.int8)
            cols = np.where(col < b1[:, None], col - b0[:, None] + 1, 0).clip(0).astype(np.int8)
            k = np.minimum(run[p], np.minimum(rows[:, :, None], cols[:, None, :])).reshape(len(p), -1)
            best = k.argmax(axis=1)  # of equal ones the first in a, then in b
            n = k[np.arange(len(p)), best].astype(np.int64)
            ok = n > 0
            p, a0, a1, b0, b1, n, best = (x[ok] for x in (p, a0, a1, b0, b1, n, best))
            i, j = best // lb - n + 1, best % lb - n + 1
            found.append(np.column_stack([p, i, j, n]))
            below += [np.column_stack([p, a0, i, b0, j]), np.column_stack([p, i + n, a1, j + n, b1])]
        todo = np.concatenate(below)
        todo = todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]
    return tuple(np.concatenate(found).T) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _batches(a: list[str], b: list[str]) -> list[np.ndarray]:
    """Places of short pairs in groups of like size."""
    width = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(width, kind="stable")
    order = order[width[order] <= SHORT]
    out, at = [], 0
    while at < len(order):
        n = max(1, CELLS // max(1, int(width[order[min(at + 511, len(order) - 1)]])) ** 2)
        out.append(order[at:at + min(n, 512)])
        at += len(out[-1])
    return out


def _shares(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the matched characters over both lengths, 1 for two empty texts."""
    out = np.ones(len(a))
    for at in _batches(a, b):
        x, y = [a[i] for i in at], [b[i] for i in at]
        pair, _, _, n = matching_blocks(x, y)
        both = np.array([len(s) + len(t) for s, t in zip(x, y)])
        matched = np.bincount(pair.astype(np.int64), n, minlength=len(at))
        out[at] = np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)
    for i, (s, t) in enumerate(zip(a, b)):
        if max(len(s), len(t)) > SHORT:
            out[i] = SequenceMatcher(None, s, t).ratio()
    return out


def _once(score: Callable, a: list, b: list) -> np.ndarray:
    """``score`` of every pair, worked out once per distinct pair; null sides and empty ones give 0, equal texts 100."""
    out = np.zeros(len(a), np.int64)
    places: dict[tuple[str, str], int] = {}
    of = np.full(len(a), -1)
    for i, (s, t) in enumerate(zip(a, b)):
        if s is None or t is None:
            continue
        if s == t:
            out[i] = 100
        elif s and t:
            of[i] = places.setdefault((s, t), len(places))
    if places:
        scores = score([s for s, _ in places], [t for _, t in places])
        out[of >= 0] = scores[of[of >= 0]]
    return out


def ratios(a: list, b: list) -> np.ndarray:
    return _once(lambda x, y: np.rint(100 * _shares(x, y)).astype(np.int64), a, b)


def partial_ratios(a: list, b: list) -> np.ndarray:
    return _once(_partial, a, b)


def _partial(a: list[str], b: list[str]) -> np.ndarray:
    short = [s if len(s) <= len(t) else t for s, t in zip(a, b)]
    long = [t if len(s) <= len(t) else s for s, t in zip(a, b)]
    out = np.zeros(len(a), np.int64)
    windows: set[tuple[int, int]] = set()
    for at in _batches(short, long):
        pair, i, j, _ = matching_blocks([short[k] for k in at], [long[k] for k in at])
        windows.update(zip(at[pair].tolist(), np.maximum(j - i, 0).tolist()))
        windows.update((int(k), len(long[k]) - len(short[k])) for k in at)  # the empty block at the ends
    for k, (s, t) in enumerate(zip(short, long)):
        if len(t) > SHORT:
            windows.update((k, max(m.b - m.a, 0)) for m in SequenceMatcher(None, s, t).get_matching_blocks())
    pairs = sorted(windows)
    share = _shares([short[k] for k, _ in pairs], [long[k][w:w + len(short[k])] for k, w in pairs])
    value = np.where(share > SAME, 100, np.rint(100 * share)).astype(np.int64)
    np.maximum.at(out, [k for k, _ in pairs], value)
    return out


_DROPPED = re.compile("[\u0080-ÿ]")
_SIGN = re.compile(r"\W")


def cleaned(text: str) -> str:
    """Characters U+0080 to U+00FF gone, signs as spaces, lower case, no space around."""
    return _SIGN.sub(" ", _DROPPED.sub("", text)).lower().strip()


def weighted_ratios(a: list, b: list) -> np.ndarray:
    known = {t: cleaned(t) for t in {*a, *b} if t is not None}
    x = [None if s is None else known[s] for s in a]
    y = [None if s is None else known[s] for s in b]
    out = _once(_weighted, x, y)
    out[[not s or not t for s, t in zip(x, y)]] = 0  # nothing left, on both sides too
    return out


def _token_forms(a: str, b: str) -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """Sorted-token texts and the pairs of the token-set comparison."""
    x, y = a.split(), b.split()
    both = set(x) & set(y)
    shared = " ".join(sorted(both))
    left, right = (" ".join(filter(None, (shared, " ".join(sorted(set(t) - both))))) for t in (x, y))
    return (" ".join(sorted(x)), " ".join(sorted(y))), [(shared, left), (shared, right), (left, right)]


def _weighted(a: list[str], b: list[str]) -> np.ndarray:
    base = ratios(a, b).astype(float)
    size = np.array([[len(s), len(t)] for s, t in zip(a, b)], float)
    apart = size.max(axis=1) / size.min(axis=1)
    near = apart < SIMILAR_LENGTH
    scale = np.where(near, 1.0, np.where(apart > VERY_DIFFERENT_LENGTH, VERY_FAR, FAR))
    best = base.copy()
    for some, score in ((near, ratios), (~near, partial_ratios)):
        rows = np.flatnonzero(some)
        if not near[rows].all():  # the text as it is, in windows
            may = rows[100 * scale[rows] > best[rows]]
            best[may] = np.maximum(best[may], score([a[i] for i in may], [b[i] for i in may]) * scale[may])
        at, x, y = [], [], []
        for i in rows[100 * TOKEN_WEIGHT * scale[rows] > best[rows]]:
            (s, t), sets = _token_forms(a[i], b[i])
            # forms equal to the texts score as the texts do, with less weight
            for u, v in [(s, t), *sets]:
                if u and v and (u, v) != (a[i], b[i]):
                    at.append(i)
                    x.append(u)
                    y.append(v)
        if at:
            at = np.array(at)
            np.maximum.at(best, at, score(x, y) * TOKEN_WEIGHT * scale[at])
    return np.rint(best).astype(np.int64)


def _column(score: Callable[[list, list], np.ndarray]) -> Callable[..., Column]:
    def of(a, b) -> Column:
        @F.pandas_udf("int")
        def scores(x: pd.Series, y: pd.Series) -> pd.Series:
            none = lambda s: [None if v is None else v for v in s]
            return pd.Series(score(none(x), none(y)))

        return scores(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)

    return of


#: Column functions (a, b) -> int 0..100; a null side gives 0
ratio, partial_ratio, weighted_ratio = _column(ratios), _column(partial_ratios), _column(weighted_ratios)


def clean(c) -> Column:
    """:func:`cleaned` as a Column function."""
    @F.pandas_udf("string")
    def forms(texts: pd.Series) -> pd.Series:
        return texts.map(cleaned, na_action="ignore")

    return forms(F.col(c) if isinstance(c, str) else c)
