"""Retrieval side: catalog rows with their vectors, cosine hit lists, batch encoding.

Nothing here forms all pairs of a group.  Hit lists are built by scoring each
catalog row against the one query vector of its group (an N:1 join).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def as_double_vector(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sequential dot product of two equal-length double arrays."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def vector_index(catalog: DataFrame, vectors: DataFrame, *, id_col: str = "id",
                 vec_col: str = "embedding") -> DataFrame:
    """Catalog rows joined to their vectors: ``id, <catalog cols>, v array<double>, v_norm``.

    One equi-join on the unique id (no skew); vectors are cast to double once
    so every later dot product is computed in double precision.
    """
    v = vectors.select(F.col(id_col), as_double_vector(vec_col).alias("v"))
    return catalog.join(v, id_col).withColumn("v_norm", l2norm("v"))


def group_anchor_hits(index: DataFrame, group_col: str, *, text_col: str = "question",
                      score_digits: int = 4, salt: int = 8) -> DataFrame:
    """Hit lists: per group, the member with the smallest id is the query and
    every other member a hit, scored ``round(100*cosine, 4)``.

    Output: ``query_id, query_text, hit_pos, id, question, score, <group_col>``.
    ``hit_pos`` is the catalog order (the id), so no window over a group is
    needed.  The anchor table has one row per group; no broadcast is forced:
    AQE measures it at runtime and broadcasts it below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``.  When it stays a
    shuffle join, the join is salted: each group's single query row is
    replicated ``salt`` times and the catalog side spread over the salts by
    a hash of the id, so a group holding a third of the catalog is split over
    ``salt`` tasks even without AQE's skew handling.
    """
    anchors = index.groupBy(group_col).agg(F.min("id").alias("query_id"))
    queries = (anchors.join(index.select(F.col("id").alias("query_id"),
                                         F.col(text_col).alias("query_text"),
                                         F.col("v").alias("qv"), F.col("v_norm").alias("q_norm")),
                            "query_id"))
    score = F.round(F.lit(100.0) * dot("v", "qv") / (F.col("v_norm") * F.col("q_norm")), score_digits)
    if salt > 1:
        queries = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        index = index.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salt)))
        keys = [group_col, "_salt"]
    else:
        keys = [group_col]
    return (index.join(queries, keys)
            .where(F.col("id") != F.col("query_id"))
            .select("query_id", "query_text", F.col("id").alias("hit_pos"), "id",
                    F.col(text_col).alias("question"), score.alias("score"), group_col))


_ENCODERS: dict[str, Callable] = {}


def _encoder(token: str, factory: Callable) -> Callable:
    """The worker's encoder for one ``encode_texts`` call; an older call's is let go."""
    if token not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[token] = factory()
    return _ENCODERS[token]


def encode_texts(df: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                 *, text_col: str = "name", out_col: str = "embedding",
                 batch_size: int = 256) -> DataFrame:
    """Batch-encode a text column with ``mapInPandas``.

    ``encoder_factory`` is called once per Python worker process (reused by its
    tasks; null texts get a null vector) and returns a function ``list[str] -> ndarray[n, dim]`` (e.g. a sentence encoder); texts
    go through it in batches of ``batch_size`` instead of one call per text.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(token, encoder_factory)
        for pdf in batches:
            there = pdf[text_col].notna()
            texts = pdf.loc[there, text_col].tolist()
            vecs: list[list[float]] = []
            for i in range(0, len(texts), batch_size):
                arr = np.asarray(encode(texts[i:i + batch_size]), dtype=np.float32)
                vecs.extend(arr.tolist())
            it = iter(vecs)
            yield pdf.assign(**{out_col: [next(it) if t else None for t in there]})

    return df.mapInPandas(run, schema)
