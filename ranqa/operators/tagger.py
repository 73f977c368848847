"""Keyword tagging: which labels of a synonym lexicon occur in a text.

The lexicon is a small dimension (label order, keywords in order).  Up to
``AUTOMATON_FROM`` keywords, tagging is a native expression over a literal
array of (keyword, label) pairs, one search of the text per keyword.  A larger
lexicon goes through a multi-pattern automaton (Aho-Corasick), built once per
Python worker: one pass over the text finds every keyword, whatever their
number.  Both give the same list.  A null text holds no keyword (empty list); a
keyword that two labels share counts for both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Lexicon = list[tuple[str, list[str]]]

# keywords from which one pass of the automaton is cheaper than a search per keyword
AUTOMATON_FROM = 100

# The reference's lexicon, label -> synonyms, in its order.
DEFAULT_LEXICON: Lexicon = [
    ("业务内涵", ["业务内涵", "业务的内涵", "内涵"]),
    ("产品资费", ["产品资费", "资费", "资费标准", "产品的资费", "套餐费用", "套餐的费用", "收费"]),
    ("业务办理", ["业务办理", "业务的办理", "办理", "办理流程", "办理方式"]),
    ("业务卖点", ["业务卖点", "业务的卖点", "特色功能", "优势"]),
    ("活动对象", ["活动对象", "对象", "活动的对象", "参与对象"]),
    ("活动卖点", ["活动卖点", "活动的卖点", "吸引点", "特别优惠"]),
    ("活动简介", ["活动简介", "活动的简介", "活动介绍", "活动的介绍", "活动的内容", "活动内容"]),
    ("活动规则", ["活动规则", "活动的规则", "规则", "参与规则", "参与的规则"]),
]


def lexicon_rows(lexicon: Lexicon) -> list[tuple[str, int, str, int]]:
    """Flatten to (label, label_ord, keyword, keyword_ord) in lexicon order."""
    rows, k = [], 0
    for li, (label, kws) in enumerate(lexicon):
        for kw in kws:
            rows.append((label, li, kw, k))
            k += 1
    return rows


def lexicon_frame(spark: SparkSession, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The lexicon as a dimension table ``label, label_ord, keyword, keyword_ord``."""
    return spark.createDataFrame(lexicon_rows(lexicon),
                                 "label string, label_ord int, keyword string, keyword_ord int")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pairs(lexicon: Lexicon) -> Column:
    return F.array(*[F.struct(F.lit(kw).alias("k"), F.lit(label).alias("l"))
                     for label, _, kw, _ in lexicon_rows(lexicon)])


@lru_cache(maxsize=8)
def _finder(keywords: tuple[str, ...]) -> Callable[[str], list[int]]:
    """text -> sorted places in ``keywords`` of those that it contains; the automaton is kept per worker."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, kw in enumerate(keywords):
        places.setdefault(kw, []).append(i)
    always = places.pop("", [])
    automaton = ahocorasick.Automaton()
    for kw in places:
        automaton.add_word(kw, kw)
    if places:
        automaton.make_automaton()

    def find(text: str) -> list[int]:
        found = {kw for _, kw in automaton.iter(text)} if places else ()
        return sorted([*always, *(i for kw in found for i in places[kw])])

    return find


def _automaton_places(text: Column, keywords: tuple[str, ...]) -> Column:
    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        find = _finder(keywords)
        return pd.Series([find(t) for t in texts])

    return places(text)


def keyword_hits(text, lexicon: Lexicon = DEFAULT_LEXICON, automaton_from: int = AUTOMATON_FROM) -> Column:
    """One label per keyword found (case-sensitive substring), lexicon order,
    duplicates kept: a label whose two synonyms both occur appears twice."""
    t = F.coalesce(_col(text), F.lit(""))
    rows = lexicon_rows(lexicon)
    if len(rows) < automaton_from:
        return F.transform(F.filter(_pairs(lexicon), lambda p: F.instr(t, p["k"]) > 0), lambda p: p["l"])
    # the worker returns numbers; labels are looked up in the JVM
    labels = F.array(*[F.lit(label) for label, *_ in rows])
    return F.transform(_automaton_places(t, tuple(kw for _, _, kw, _ in rows)), lambda i: F.get(labels, i))


def tag_labels(text, lexicon: Lexicon = DEFAULT_LEXICON, automaton_from: int = AUTOMATON_FROM) -> Column:
    """Distinct labels found, in lexicon (label) order."""
    return F.array_distinct(keyword_hits(text, lexicon, automaton_from))


def tag_string(text, lexicon: Lexicon = DEFAULT_LEXICON, sep: str = ",") -> Column:
    return F.array_join(tag_labels(text, lexicon), sep)

