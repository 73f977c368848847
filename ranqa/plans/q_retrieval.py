"""Registered queries of the retrieval side: catalog-wide fuzzy top-k, the
persisted vector index, batch encoding."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ranqa.functions import blocks
from ranqa.functions.fuzzy import weighted_ratio
from ranqa.operators.encoder import encode, fit_encoder
from ranqa.operators.fuzzy_index import fuzzy_catalog_topk
from ranqa.operators.retrieval import l2norm
from ranqa.plans.fixtures import indexed_catalog
from ranqa.plans.registry import r6, register
from ranqa.plans.sql_blocks import block_scores
from ranqa.plans.sql_common import q
from ranqa.plans.sql_rerank import r6 as s6
from ranqa.plans.sql_rerank import sql_lev_ratio, sql_weighted_ratio
from ranqa.operators.vector_index import build_index, search
from ranqa.session import ensure_checkpoint_dir, shared_dir, write_shared
from ranqa.sources.sinks import read_index, write_index
from ranqa.sources.tables import table

# Parameter of the registered queries: probe questions in the catalog's
# language, including noise probes as the reference's probe list has.
TEST_PROBES = ["small ring", "red widget", "blue bolt", "gear", "widget", "hot", "ring small",
               "xxx", "ffffffff", "mmmmmmmmmmm", "test", "5G"]
TOP_K = 8


def probes(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(TEST_PROBES)], "probe_id bigint, probe_text string")


def _catalog(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


_PROBES_SQL = "(VALUES " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(TEST_PROBES)) + \
    ") AS pr(probe_id, probe_text)"


@register("fuzzy_catalog_join", "J7 D2: per probe, top-8 catalog entries by edit ratio (exact)", f"""
SELECT probe_id, probe_text, rank, id, name, fuzzy FROM (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY fuzzy DESC, id ASC) AS rank FROM (
    SELECT CAST(pr.probe_id AS BIGINT) AS probe_id, pr.probe_text, p.p_partkey AS id, p.p_name AS name,
           {sql_lev_ratio('pr.probe_text', 'p.p_name')} AS fuzzy
    FROM part p CROSS JOIN {_PROBES_SQL}))
WHERE rank <= {TOP_K}""")
def fuzzy_catalog_join(spark, sf):
    return fuzzy_catalog_topk(probes(spark), _catalog(spark, sf), k=TOP_K)


@register("fuzzy_catalog_wratio", "J7 D2 F2: per probe, top-8 catalog entries by weighted ratio", f"""
SELECT probe_id, probe_text, rank, id, name, fuzzy FROM (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY fuzzy DESC, id ASC) AS rank FROM (
    SELECT CAST(pr.probe_id AS BIGINT) AS probe_id, pr.probe_text, p.p_partkey AS id, p.p_name AS name,
           {sql_weighted_ratio('pr.probe_text', 'p.p_name')} AS fuzzy
    FROM part p CROSS JOIN {_PROBES_SQL}))
WHERE rank <= {TOP_K}""")
def fuzzy_catalog_wratio(spark, sf):
    return fuzzy_catalog_topk(probes(spark), _catalog(spark, sf), k=TOP_K, scorer=weighted_ratio)


@register("fuzzy_catalog_blocks", "J7 D2 F2: per probe, top-8 catalog entries by the matching-block weighted ratio", f"""
WITH RECURSIVE probe_pairs AS (SELECT DISTINCT pr.probe_text AS a, p.p_name AS b FROM part p CROSS JOIN {_PROBES_SQL}),
{block_scores('probe_pairs')}
SELECT probe_id, probe_text, rank, id, name, fuzzy FROM (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY fuzzy DESC, id ASC) AS rank FROM (
    SELECT CAST(pr.probe_id AS BIGINT) AS probe_id, pr.probe_text, p.p_partkey AS id, p.p_name AS name, bs.weighted AS fuzzy
    FROM part p CROSS JOIN {_PROBES_SQL} JOIN bs ON bs.a = pr.probe_text AND bs.b = p.p_name))
WHERE rank <= {TOP_K}""")
def fuzzy_catalog_blocks(spark, sf):
    return fuzzy_catalog_topk(probes(spark), _catalog(spark, sf), k=TOP_K, scorer=blocks.weighted_ratio)


@register("index_roundtrip", "S7 S8: vector + text index written as parquet and read back", f"""
SELECT p.p_partkey AS id, p.p_name AS name, len(e.embedding) AS dim,
       {s6("sqrt(list_reduce(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x), lambda a, x: a + x))")} AS norm
FROM part p JOIN embeddings e ON p.p_partkey = e.vec_id""")
def index_roundtrip(spark, sf):
    idx = indexed_catalog(spark, sf).select("id", F.col("question").alias("name"),
                                            F.col("v").cast("array<float>").alias("embedding"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"index-{uuid.uuid4().hex}")
    write_index(idx, path)
    back = read_index(spark, path)
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return back.select("id", "name", F.size("embedding").alias("dim"), r6(l2norm(vec)).alias("norm"))


NEAREST = 10
ENCODED = 32   # dimensions of the trained encoder
_SQL_COSINE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS s FROM v),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e) / (a.s * b.s), 9) AS score
          FROM u a JOIN u b ON a.vec_id <> b.vec_id)"""


def _vector_index(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = os.path.join(shared_dir(spark), f"ivf-{uuid.uuid4().hex}")
    build_index(vecs, path)
    return path, vecs


@register("vector_topk", "H1 S7 S8: ten nearest of every vector through the inverted-file index, exact mode", f"""
{_SQL_COSINE}
SELECT query_id, rank, id, {s6('score')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
WHERE rank <= {NEAREST}""")
def vector_topk(spark, sf):
    path, vecs = _vector_index(spark, sf)
    return search(spark, path, vecs, NEAREST, exact=True).select("query_id", "rank", "id", r6("score").alias("score"))


@register("vector_topk_probed", "H1: ten nearest of every vector from its nearest cells only (recall is tested)")
def vector_topk_probed(spark, sf):
    path, vecs = _vector_index(spark, sf)
    return search(spark, path, vecs, NEAREST).select("query_id", "rank", "id", r6("score").alias("score"))


@register("encode_catalog", "D17 F4: batch encoding of the distinct catalog with an encoder trained on it")
def encode_catalog(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    enc = encode(names, fit_encoder(names, dimensions=ENCODED))
    return enc.select("name", F.size("embedding").alias("dim"),
                      F.round(l2norm(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("norm"))


@register("encoded_topk", "D17 F4 H1 S7 S8: encode the whole catalog, index the vectors, five nearest names of every name")
def encoded_topk(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    names = part.groupBy("name").agg(F.min("id").alias("id"))  # a name's vector once
    vecs = write_shared(encode(names, fit_encoder(names, dimensions=ENCODED)).select("id", "name", "embedding"))
    path = os.path.join(shared_dir(spark), f"encoded-{uuid.uuid4().hex}")
    build_index(vecs, path)
    near = search(spark, path, vecs, 5, exact=True)
    return near.join(vecs.select(F.col("id").alias("query_id"), F.col("name").alias("query")), "query_id").join(
        vecs.select("id", "name"), "id").select("query_id", "query", "rank", "id", "name", F.round("score", 4).alias("score"))
