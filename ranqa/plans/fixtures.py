"""Inputs derived from the driver tables, identically in Spark and in SQL.

* indexed catalog: ``part`` rows that have a vector in ``embeddings``
  (``p_partkey = vec_id``), name as the entry text, brand as its group.
* hit lists: per brand, the entry with the smallest key is the query; every
  other entry of the brand is a hit scored ``round(100*cosine, 4)``.  Work is
  linear in the catalog (each hit meets exactly one query vector).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.operators.retrieval import group_anchor_hits, vector_index
from ranqa.session import cut_lineage
from ranqa.sources.tables import table


def indexed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), "p_brand")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_index(part, vecs)


def brand_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit table, written once to the shared checkpoint folder.

    It stands in for a search system's result table: the re-ranker reads it
    several times (statistics, candidates, final lookup), so it is produced
    once instead of re-deriving the cosine scores per read.
    """
    return cut_lineage(group_anchor_hits(indexed_catalog(spark, sf_dir), "p_brand"))


# ---- the same derivation as SQL (DuckDB dialect), used by the oracle -------

SQL_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda acc, x: acc + x)"


def sql_dot(a: str, b: str) -> str:
    return SQL_DOT.format(a=a, b=b)


SQL_HITS_CTE = f"""
idx0 AS (
  SELECT p.p_partkey AS id, p.p_name AS question, p.p_brand,
         CAST(e.embedding AS DOUBLE[]) AS v
  FROM part p JOIN embeddings e ON p.p_partkey = e.vec_id),
idx AS (SELECT *, sqrt({sql_dot('v', 'v')}) AS v_norm FROM idx0),
anchors AS (SELECT p_brand, min(id) AS query_id FROM idx GROUP BY p_brand),
qv AS (
  SELECT a.p_brand, a.query_id, i.question AS query_text, i.v AS qv, i.v_norm AS q_norm
  FROM anchors a JOIN idx i ON i.id = a.query_id),
hits AS (
  SELECT q.query_id, q.query_text, i.id AS hit_pos, i.id, i.question,
         round(100.0 * {sql_dot('i.v', 'q.qv')} / (i.v_norm * q.q_norm), 4) AS score,
         i.p_brand
  FROM idx i JOIN qv q ON i.p_brand = q.p_brand
  WHERE i.id <> q.query_id)"""
