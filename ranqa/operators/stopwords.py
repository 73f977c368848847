"""Stopword removal: segment a text, drop stopwords, join the rest.

Spaced text is tokenised natively (``regexp_extract_all`` on non-whitespace
runs, the same split as Python's ``str.split()``) and filtered with a
higher-order function against a literal set, so it stays in codegen.
Unspaced text (Chinese) needs dictionary segmentation; that is an Arrow UDF
doing forward maximum matching against a user dictionary, with one
dictionary per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.functions.text import WHITESPACE_CLASS

# a token is a maximal run of characters outside the whitespace set
TOKEN_PATTERN = "[^" + WHITESPACE_CLASS[1:-2] + "]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Maximal non-whitespace runs, as ``str.split()``: split on whitespace
    runs, then drop the empty strings left by leading/trailing whitespace
    (``split`` is several times faster than extracting every match)."""
    return F.filter(F.split(_col(text), WHITESPACE_CLASS), lambda t: t != F.lit(""))


def runs(text) -> Column:
    """The text cut between whitespace and other characters, every character kept."""
    return F.regexp_extract_all(_col(text), F.lit(f"{WHITESPACE_CLASS}|{TOKEN_PATTERN}"), F.lit(0))


def drop_stopwords(toks: Column, stopwords: list[str]) -> Column:
    """Filter a token array against the stopword set (order and repeats kept)."""
    stop = sorted(set(stopwords))
    return F.filter(toks, lambda t: ~t.isin(stop))  # a hash set for longer lists


# stopwords up to which they are removed by one pattern
PATTERN_WORDS = 500


def _whole_token(stopwords: list[str]) -> str:
    """Pattern of a token that is one of the stopwords: white space or an end of the text on both sides."""
    inside = WHITESPACE_CLASS[:-1]
    other = "[^" + inside[1:]
    return f"(?<!{other})(?:" + "|".join(re.escape(w) for w in sorted(set(stopwords), key=lambda w: (-len(w), w))) + f")(?!{other})"


def remove_stopwords(text, stopwords: list[str], sep: str = "", segmenter: str | Callable[[Column], Column] = "space",
                     dictionary: list[str] | None = None) -> Column:
    """Kept tokens of ``text`` joined by ``sep``.  Joined with '' (the default) white space counts as tokens, so what is
    left keeps its spacing; with another ``sep`` it only separates.  For unspaced text ``segmenter`` is a Column function to words
    (``operators.segment.segmenter``), or "dict" for the longest words of ``dictionary``."""
    words = [w for w in stopwords if w]
    if segmenter == "space" and sep == "" and 0 < len(words) <= PATTERN_WORDS and not any(c.isspace() for w in words for c in w):
        # the text as it is, less the tokens that are stopwords
        return F.regexp_replace(_col(text), _whole_token(words), "")
    if callable(segmenter):
        toks = segmenter(_col(text))
    elif segmenter == "space":
        toks = runs(text) if sep == "" else tokens(text)
    else:
        toks = segment_udf(dictionary or [])(_col(text))
    return F.array_join(drop_stopwords(toks, stopwords), sep)


def max_match(text: str, words: set[str], max_len: int) -> list[str]:
    """Forward maximum matching; characters outside the dictionary, white space
    included, stand alone."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        if text[i].isspace():
            out.append(text[i])
            i += 1
            continue
        for L in range(min(max_len, n - i), 0, -1):
            piece = text[i:i + L]
            if L == 1 or piece in words:
                if not any(ch.isspace() for ch in piece):
                    out.append(piece)
                    i += L
                    break
        else:
            i += 1
    return out


def segment_udf(dictionary: list[str]):
    words = {w for w in dictionary if w}
    max_len = max((len(w) for w in words), default=1)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else max_match(t, words, max_len) for t in texts])

    return segment
