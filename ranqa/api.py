"""Reference-shaped entry points, each a thin call into the DataFrame operators.

For users moving over from per-question Python calls: the same names and
arguments, but the work runs as Spark jobs (pass a DataFrame of many queries
to the operators directly to batch them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.functions.blocks import partial_ratio, weighted_ratio
from ranqa.operators.fuzzy_index import fuzzy_catalog_topk
from ranqa.operators.rerank import rerank
from ranqa.operators.stopwords import remove_stopwords
from ranqa.operators.templates import SYSTEM_PROMPT

HIT_SCHEMA = "query_id bigint, query_text string, hit_pos bigint, id string, question string, score double"


def search_similar_packages(spark: SparkSession, query: str, packages: DataFrame | list[str],
                            limit: int = 8, text_col: str = "name") -> DataFrame:
    """Top-``limit`` catalog texts for one query by the matching-block weighted
    ratio (ties keep catalog order)."""
    if isinstance(packages, list):
        packages = spark.createDataFrame([(i, p) for i, p in enumerate(packages)], "id bigint, name string")
        text_col = "name"
    elif "id" not in packages.columns:
        packages = packages.withColumn("id", F.monotonically_increasing_id())
    probes = spark.createDataFrame([(0, query)], "probe_id bigint, probe_text string")
    return fuzzy_catalog_topk(probes, packages.select("id", F.col(text_col).alias("name")),
                              k=limit, scorer=weighted_ratio)


def search_similar_packages_with_score(spark: SparkSession, Q: str, result: DataFrame | list[dict],
                                       limit: int = 5) -> DataFrame | list[dict]:
    """Re-rank one query's hits (``id`` of any type, ``question``, ``score``, payload) with
    the matching-block substring gate and weighted ranking.

    A DataFrame gives the kept hits with their payload; a list of dicts gives
    the kept dicts themselves, in rank order.  Of hits that repeat an id the last counts.
    """
    if isinstance(result, list):
        rows = [(0, Q, pos, f"{type(h['id']).__name__}:{h['id']}", h.get("question"), float(h["score"]))
                for pos, h in enumerate(result)]
        hits = spark.createDataFrame(rows, HIT_SCHEMA)
        kept = rerank(hits, limit=limit, gate_scorer=partial_ratio, rank_scorer=weighted_ratio, dedupe_ids=True)
        return [result[r["hit_pos"]] for r in kept.orderBy("rank").select("hit_pos").collect()]   # at most FINAL_K
    hits = result
    if "hit_pos" not in hits.columns:
        hits = hits.withColumn("hit_pos", F.monotonically_increasing_id())
    hits = hits.withColumn("query_id", F.lit(0).cast("bigint")).withColumn("query_text", F.lit(Q))
    return rerank(hits, limit=limit, gate_scorer=partial_ratio, rank_scorer=weighted_ratio, dedupe_ids=True)


def remove_stopwords_col(text_col: str, stopwords: list[str], dictionary: list[str] | None = None):
    """Column form: dictionary segmentation when a dictionary is given, joined with ''."""
    if dictionary is not None:
        return remove_stopwords(text_col, stopwords, sep="", segmenter="dict", dictionary=dictionary)
    return remove_stopwords(text_col, stopwords, sep="")


DEFAULT_SYSTEM_PROMPT = SYSTEM_PROMPT
