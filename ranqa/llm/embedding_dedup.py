"""Near copies among embeddings: spherical k-means cells, blocked cosine products, one vector kept per group.

1. Equal vectors collapse to one with a weight (partial aggregation, so a huge group of copies costs one row).
2. Spherical k-means on a bounded sample gives the centres; every vector gets its home cell.
3. A vector also visits cells that may be the home of a linked vector.  With u the unit vector from a cell's centre to
   the home cell's, linked vectors x and y on both sides of the bisecting plane have x.u - y.u <= |x - y|, so one of them
   is within half of the longest |x - y| of the plane; that one visits the other's home.  This holds for any data.
   A given ``z`` uses the bound x.u <= tan t * z / sqrt(effective dimensions) where that is smaller, which loses links whose
   displacement singles out u; no query uses it.
4. Each cell compares its visitors and members with its members in blocks of bounded size: single precision finds,
   double precision decides.  Products are counted in place, for the member too when it does not visit the visitor's
   home; a block returns one count per vector and a spanning forest of its links, never the pairs.
5. Components of the forests name the groups; the smallest ``vec_id`` of a group is kept.

Vectors of different lengths have no cosine: every length has centres and cells of its own, all in the same jobs.  Nodes are
distinct vectors, so unlike vectors under one id are apart.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with
a null id (kept, without a component); repeated rows, and rows that repeat an id, are vectors of their own; an empty table gives
no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, maybe_broadcast, table
from ranqa.llm.components import components, local_forest
from ranqa.session import write_shared

SIMILARITY, Z = 0.95, 5.0
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 20_000, 1_500, 4_096
HOME_BLOCK, QUERY_BLOCK = 2_048, 16_384


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """``k`` unit centres of the unit rows ``x``."""
    rnd = np.random.default_rng(seed)
    centres = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return np.unique(centres, axis=0)


def effective_dimensions(x: np.ndarray) -> float:
    """Participation ratio of the variances along the principal axes."""
    c = x - x.mean(axis=0)
    v = np.linalg.eigvalsh(c.T @ c).clip(0)
    return float(v.sum() ** 2 / max((v * v).sum(), 1e-300)) if v.sum() > 0 else 1.0


def margin(similarity: float, z: float | None, dims: float) -> float:
    """Largest x.u of a vector that still visits a cell: half of the longest |x - y| of linked x and y."""
    half = math.sqrt((1 - similarity) / 2)
    if z is None:
        return half + 1e-9
    return min(half, math.sqrt(1 - similarity ** 2) / similarity * z / math.sqrt(max(dims - 1, 1e-9))) + 1e-9


def cells_of(x: np.ndarray, centres: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of every row and the other cells that it visits."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-300))
    # products, not quotients: centres that are nearly equal are apart by less than the error
    near = dots[np.arange(len(x)), home][:, None] - dots <= limit * apart[home] + 1e-7
    near[np.arange(len(x)), home] = False
    return home, [np.flatnonzero(r) for r in near]


def visited(visits: pa.Array, cells: int) -> np.ndarray:
    """Table of rows by cells: whether the row visits the cell."""
    if isinstance(visits, pa.ChunkedArray):
        visits = visits.combine_chunks()
    out = np.zeros((len(visits), cells), bool)
    out[np.repeat(np.arange(len(visits)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()] = True
    return out


def block_links(query: np.ndarray, q_ids: np.ndarray, q_weight: np.ndarray, q_home: np.ndarray, home: np.ndarray,
                h_ids: np.ndarray, h_weight: np.ndarray, h_meets: np.ndarray,
                similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(summed weight of linked members by query row, of linked queries that the member does not meet in their home by
    member row, forest links from, to) of one block."""
    ids = np.unique(np.concatenate([q_ids, h_ids]))
    qi, hi = np.searchsorted(ids, q_ids), np.searchsorted(ids, h_ids)
    count, back, root = np.zeros(len(q_ids), np.int64), np.zeros(len(h_ids), np.int64), np.arange(len(ids))
    q32, h32 = query.astype(np.float32), home.astype(np.float32).T
    step = 256
    for at in range(0, len(query), step):
        i, j = np.nonzero(q32[at:at + step] @ h32 >= similarity - 1e-4)
        i += at
        real = qi[i] != hi[j]
        i, j = i[real], j[real]
        exact = np.empty(len(i))
        for k in range(0, len(i), 100_000):
            exact[k:k + 100_000] = np.einsum("ij,ij->i", query[i[k:k + 100_000]], home[j[k:k + 100_000]])
        i, j = i[exact >= similarity], j[exact >= similarity]
        if not len(i):
            continue
        count += np.bincount(i, h_weight[j], minlength=len(q_ids)).astype(np.int64)
        once = ~h_meets[j, q_home[i]]
        back += np.bincount(j[once], q_weight[i[once]], minlength=len(h_ids)).astype(np.int64)
        a, b = root[qi[i]], root[hi[j]]
        pairs = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        root = local_forest(pairs // len(ids), pairs % len(ids), len(ids))[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return count, back, ids[moved], ids[root[moved]]


def near_copies(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                similarity: float = SIMILARITY, z: float | None = None, cell_rows: int = CELL_ROWS,
                sample_rows: int = SAMPLE_ROWS, home_block: int = HOME_BLOCK,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~odd & F.exists("e", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("key", F.struct(F.size("e").alias("d"), F.xxhash64("e"), F.xxhash64("e", F.lit(1))))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    # the node's number is written with it, so that it is fixed
    one = write_shared(rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"),
                                                           F.first("e").alias("e"))
                       .withColumn("id", F.monotonically_increasing_id()))
    sizes = {r["d"]: r["n"] for r in one.groupBy("key.d").agg(F.count("*").alias("n")).orderBy("d").collect()}  # one per length
    if not sizes:
        return alone
    n = sum(sizes.values())
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))
    sample = one.where(part | F.lit(n <= sample_rows)).select("key.d", "id", "e").orderBy("d", "id").toArrow()
    cells: dict[int, tuple[int, np.ndarray, float]] = {}  # length -> (number of the first cell, centres, limit)
    n_cells = 0
    for d, m in sizes.items():
        own = sample.filter(pc.equal(sample["d"], d))
        x = unit_rows(own["e"]) if len(own) else np.zeros((0, d))
        k = max(1, min(MAX_CELLS, -(-m // cell_rows), len(x) // 8))
        centres = spherical_kmeans(x, k) if len(x) else np.zeros((1, d))
        cells[d] = (n_cells, centres, margin(similarity, z, effective_dimensions(x) if z is not None and len(x) else 1.0))
        n_cells += len(centres)
    shared = spark.sparkContext.broadcast(cells)  # MAX_CELLS rows per length at most
    found = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])

    def make():
        def run(e: pa.Array) -> list[pa.Array]:
            homes, visits = np.zeros(len(e), np.int32), [[] for _ in range(len(e))]
            sizes = pc.list_value_length(e).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                first, centres, limit = shared.value[int(d)]
                own = np.flatnonzero(sizes == d)
                for at in range(0, len(own), 1000):
                    some = own[at:at + 1000]
                    h, v = cells_of(unit_rows(e.take(pa.array(some))), centres, limit)
                    homes[some] = first + h
                    for i, r in zip(some, v):
                        visits[i] = (first + r).tolist()
            return [pa.array(homes), pa.array(visits, pa.list_(pa.int32()))]
        return run

    placed = write_shared(append_columns(one, ["e"], found, make))
    # sizes of cells: at most MAX_CELLS rows
    members = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    guests = {r["c"]: r["n"] for r in placed.select(F.explode("visits").alias("c")).groupBy("c")
              .agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(c, -(-m // home_block), -(-(m + guests.get(c, 0)) // query_block)) for c, m in sorted(members.items())],
        "cell int, hb int, qb int")
    spread = lambda col, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(col)).cast("int")
    range_ = lambda col: F.explode(F.sequence(F.lit(0), F.col(col) - 1))
    base = placed.select("id", "w", "e", "home", F.concat(F.array("home"), "visits").alias("cells"))
    homes = (base.join(F.broadcast(plan), F.col("home") == F.col("cell"))
             .select("cell", spread("hb", 1).alias("h"), range_("qb").alias("q"), F.lit(True).alias("member"), "id", "w", "e", "home",
                     "cells"))
    queries = (base.select("id", "w", "e", "home", F.explode("cells").alias("c"))
               .join(F.broadcast(plan), F.col("c") == F.col("cell"))
               .select("cell", range_("hb").alias("h"), spread("qb", 2).alias("q"), F.lit(False).alias("member"), "id", "w", "e",
                       "home", F.array().cast("array<int>").alias("cells")))

    def compare(t: pa.Table) -> pa.Table:
        member = t["member"].to_numpy()
        x, ids, w, home = unit_rows(t["e"]), t["id"].to_numpy(), t["w"].to_numpy(), t["home"].to_numpy()
        count, back, u, v = block_links(x[~member], ids[~member], w[~member], home[~member], x[member], ids[member], w[member],
                                        visited(t["cells"].filter(t["member"]), n_cells), similarity)
        n, ids = np.concatenate([count, back]), np.concatenate([ids[~member], ids[member]])
        some = n > 0
        return pa.table({"u": np.concatenate([ids[some], u]),
                         "v": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), v]),
                                       mask=np.arange(some.sum() + len(u)) < some.sum()),
                         "n": np.concatenate([n[some], np.zeros(len(u), np.int64)])})

    links = write_shared(homes.unionByName(queries).groupBy("cell", "h", "q").applyInArrow(
        compare, "u long, v long, n long"))
    counts = links.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(links.where("v is not null").select("u", "v"))
    nodes = write_shared(one.select("key", "first", "id", "w").join(counts, "id", "left").join(
        groups, F.col("id") == F.col("node"), "left").select(
        "key", "first", "component", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links")))
    smallest = nodes.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id"))
    named = nodes.join(maybe_broadcast(smallest), F.col("component") == F.col("c"), "left").select(
        "key", "n_links", F.coalesce("component_id", "first").alias("component_id"))
    linked = rows.where("ok").select("vec_id", "key").join(named, "key").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its group and whether it is the group's representative."""
    return near_copies(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS s FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= {SIMILARITY}),
reach(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT u.vec_id, (SELECT count(*) FROM links l WHERE l.a = u.vec_id) AS n_links, c.component_id,
  u.vec_id = c.component_id AS kept
FROM u JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = u.vec_id
"""
