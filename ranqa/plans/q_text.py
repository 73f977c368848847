"""Registered queries of the text side: stopword removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.functions.text import WHITESPACE_CLASS, strip_whitespace
from ranqa.operators.segment import MAX_WORDS, segmenter, word_counts
from ranqa.operators.stopwords import TOKEN_PATTERN, drop_stopwords, remove_stopwords, tokens
from ranqa.operators.word_shapes import character_states
from ranqa.plans.registry import register
from ranqa.plans.sql_common import q, sql_list
from ranqa.sources.tables import table

# Parameter of the registered query: function words of the driver's four
# languages (the reference's own list is Chinese and is caller data here).
TEST_STOPWORDS = ["the", "and", "of", "in", "to", "a", "is", "it", "that", "for", "with", "as", "by",
                  "on", "was", "are", "The", "le", "la", "les", "de", "des", "et", "un", "une", "du",
                  "die", "der", "und", "das", "ein", "zu", "el", "los", "las", "y", "que", "en"]


def _sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(TOKEN_PATTERN)})"


def _sql_kept(x: str) -> str:
    return f"list_filter({_sql_tokens(x)}, lambda t: NOT list_contains({sql_list(sorted(set(TEST_STOPWORDS)))}, t))"


@register("stopwords", "D8 X15: tokens, stopwords dropped, rest joined (whole documents)", f"""
SELECT doc_id, len({_sql_tokens('text')}) AS n_tokens, len({_sql_kept('text')}) AS n_kept,
       array_to_string({_sql_kept('text')}, ' ') AS cleaned FROM documents""")
def stopwords_q(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    toks = d.select("doc_id", tokens("text").alias("toks"))
    kept = toks.select("doc_id", "toks", drop_stopwords(F.col("toks"), TEST_STOPWORDS).alias("kept"))
    return kept.select("doc_id", F.size("toks").alias("n_tokens"), F.size("kept").alias("n_kept"),
                       F.array_join("kept", " ").alias("cleaned"))


@register("stopwords_joined", "D8: stopwords removed, everything else (white space too) joined as it was", f"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, {q(WHITESPACE_CLASS + "|" + TOKEN_PATTERN)}),
  lambda t: NOT list_contains({sql_list(TEST_STOPWORDS)}, t)), '') AS cleaned FROM documents""")
def stopwords_joined(spark, sf):
    return table(spark, sf, "documents").select("doc_id", remove_stopwords("text", TEST_STOPWORDS).alias("cleaned"))


@register("word_counts", "D8 F3: corpus word counts that weigh the segmenter's dictionary", f"""
SELECT w AS word, count(*) AS n FROM (SELECT unnest({_sql_tokens('text')}) AS w FROM documents) WHERE length(w) <= 32
GROUP BY w ORDER BY n DESC, w LIMIT {MAX_WORDS}""")
def word_counts_q(spark, sf):
    return word_counts(table(spark, sf, "documents"))


@register("segment_documents", "D8 F3: whole documents without white space cut into words by the most probable path")
def segment_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = segmenter(spark, word_counts(docs), ["GmbH"])
    # a table of one row group scans in one task; cutting is the work here, so tasks grow in number with the table
    spread = docs.repartition("doc_id")
    bare = spread.select("doc_id", strip_whitespace("text").alias("bare"))
    words = bare.select("doc_id", "bare", cut("bare").alias("words"))
    return words.select("doc_id", F.size("words").alias("n_words"), (F.array_join("words", "") == F.col("bare")).alias("whole"),
                        F.md5(F.array_join("words", "|")).alias("words_md5"),
                        F.size(drop_stopwords(F.col("words"), TEST_STOPWORDS)).alias("n_kept"))


@register("character_states", "D8 F3: places of characters in the corpus's words and the moves between them", f"""
WITH t AS (SELECT row_number() OVER () AS r, {_sql_tokens('text')} AS ws FROM documents),
e AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
p AS (SELECT w, lead(w) OVER (PARTITION BY r ORDER BY i) AS nxt FROM e),
d AS (SELECT w, CASE WHEN length(nxt) > 1 THEN 'B' WHEN length(nxt) = 1 THEN 'S' END AS after, length(w) AS size,
        CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL HAVING length(w) <= 32),
c AS (SELECT w, after, size, n, unnest(range(1, size + 1)) AS k FROM d),
s AS (SELECT *, CASE WHEN size = 1 THEN 'S' WHEN k = 1 THEN 'B' WHEN k = size THEN 'E' ELSE 'M' END AS state,
        CASE WHEN k = size THEN after WHEN k + 1 = size THEN 'E' ELSE 'M' END AS nxt FROM c),
a AS (SELECT state, NULL AS next, substring(w, k, 1) AS character, n FROM s
  UNION ALL SELECT state, nxt, NULL, n FROM s WHERE nxt IS NOT NULL)
SELECT state, next, character, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY state, next, character""")
def character_states_q(spark, sf):
    return character_states(table(spark, sf, "documents"))


# words seen less often than this are unknown to the registered query's dictionary
KNOWN_FROM = 20


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ends(words: pd.Series) -> pd.Series:
    """Places in the joined text where a word ends."""
    return words.map(lambda ws: None if ws is None else np.cumsum([len(w) for w in ws], dtype=np.int64))


@register("segment_unknown", "D8 F3: whole documents without white space cut with a dictionary of frequent words and the "
                             "model of unknown ones, word ends compared with the spaced text")
def segment_unknown(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = segmenter(spark, word_counts(docs, min_count=KNOWN_FROM), states=character_states(docs))
    spread = docs.repartition("doc_id")
    words = spread.select("doc_id", tokens("text").alias("spaced"), cut(strip_whitespace("text")).alias("words"))
    ends = words.select("doc_id", _ends("spaced").alias("spaced"), _ends("words").alias("words"))
    return ends.select("doc_id", F.size("spaced").alias("n_spaced"), F.size("words").alias("n_words"),
                       F.size(F.array_intersect("spaced", "words")).alias("n_same_ends"))
