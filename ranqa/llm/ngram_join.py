"""Jaccard self-join of documents on word n-grams by a MinHash LSH forest.

1. A document is its set of hashed runs of five words (words: lower case, split at white space; a text of one to four
   words is one run).  Equal sets collapse to one class with a weight.
2. ``TREES`` prefix tries hold the signatures' parts of ``DEPTH`` MinHash values.  The shortest prefix is the longest one
   that finds a pair at the threshold in some trie with the target recall.
   Documents that share it meet in a bucket, sorted in trie order; from the deepest shared prefix to the shortest,
   members not yet joined are compared by their signatures and joined when the estimate is within
   four deviations of the threshold.  A bucket returns a spanning forest, never its pairs.
3. Components of the forests are the candidate clusters.  Each cluster's texts meet in blocks of bounded size, where all
   pairs are verified exactly and counted in place; verified links are returned as a spanning forest and as
   counts per document.
4. Components of the verified links are the groups.

Large buckets and clusters are dealt into blocks and compared by pairs of blocks, so no task holds a whole one.

Nodes are (id, digest of the text) of a class's first row, so unlike texts under one id are nodes of their own.

Defined results: rows that repeat an id are counted each and linked by their texts; a group is named by its smallest id,
and ``class_digest`` tells groups with the same one apart.  Null, empty and blank texts hold no run and link with nothing, nor do rows with a null id (their group is null); an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, block_pairs, clustered_map, maybe_broadcast, mix64, rolling, table, tokens
from ranqa.llm.components import components, local_forest
from ranqa.session import write_shared

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 16, 8, 0.9995
BUCKET_BLOCK = 4_096                 # documents of a bucket that one task compares
VERIFY_ROWS, VERIFY_RUNS = 1_024, 500_000  # documents and runs of a cluster's block

_rnd = np.random.default_rng(20240229)
MULTIPLIERS = _rnd.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = T.StructType([T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()),
                       T.StructField("runs", T.LongType()), T.StructField("sig", T.BinaryType())])


#: a class of equal run sets by its first row; ordered by the id, so the smallest node of a group has its smallest id
NODE = "struct<doc_id: long, digest: long>"


def run_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words."""
    return np.unique(rolling(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(runs: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), 2048):
        np.minimum(low, (mix64(runs[at:at + 2048])[:, None] * MULTIPLIERS).min(axis=0), out=low)
    return (mix64(low) & np.uint64(255)).astype(np.uint8)


def shortest_prefix(similarity: float, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Longest prefix length at which a pair at the threshold meets in some trie with the target recall."""
    return max([d for d in range(1, depth + 1) if 1 - (1 - similarity ** d) ** trees >= target], default=1)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest, fingerprint of the run set, number of runs, signature); a set without runs has no signature."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            cols: list[list] = [[], [], [], []]
            for w in tokens(texts):
                s = run_set(w)
                m = mix64(s)
                values = (int(m.sum(dtype=np.uint64).view(np.int64)), int(mix64(m ^ np.uint64(len(s))).sum(
                    dtype=np.uint64).view(np.int64)), len(s), signature(s).tobytes() if len(s) else None)
                for c, v in zip(cols, values):
                    c.append(v)
            return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return run

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                      F.col(text).alias("text"))
    return append_columns(src, ["text"], SKETCH, make).drop("text")


def bucket_forest(sig: np.ndarray, part: np.ndarray, shortest: int, least: float) -> np.ndarray:
    """Root of each row after joining rows whose signatures agree in a share of at least ``least``.

    ``part`` is the rows' part of the trie, which agrees in the first ``shortest`` values; deeper prefixes go first.
    """
    n, root = len(sig), np.arange(len(sig))
    need = int(np.ceil(least * sig.shape[1]))
    if n == 2:
        return np.zeros(2, int) if (sig[0] == sig[1]).sum() >= need else root
    order = np.lexsort(part.T[::-1])
    p = part[order]
    common = np.cumprod(p[1:] == p[:-1], axis=1).sum(axis=1)  # shared prefix of neighbours in trie order

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        root = local_forest(root[a], root[b], n)[root]

    for depth in range(part.shape[1], shortest - 1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(common < depth) + 1, [n]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            rows = order[s:e]
            if e - s < 2 or (root[rows] == root[rows[0]]).all():
                continue
            near = rows[(sig[rows] == sig[rows[0]]).sum(axis=1) >= need]  # with the first member
            join(near, np.full(len(near), rows[0]))
            names, sizes = np.unique(root[rows], return_counts=True)
            if len(names) == 1:
                continue
            # everything outside the largest joined set against all others
            for i in rows[root[rows] != names[sizes.argmax()]]:
                others = rows[root[rows] != root[i]]
                for at in range(0, len(others), 4096):
                    some = others[at:at + 4096]
                    near = some[(sig[some] == sig[i]).sum(axis=1) >= need]
                    join(near, np.full(len(near), i))
    return root


def verify_block(sets: list[np.ndarray], blk: np.ndarray, weight: np.ndarray, similarity: float,
                 same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(summed weight of linked rows by row, root by row) for exact Jaccard links.

    ``same``: all pairs; otherwise only pairs of rows from different blocks.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[inverse] > 1  # runs of one row only add nothing to an intersection
    owner, inverse = owner[keep], inverse[keep]
    named = np.cumsum(times > 1) - 1
    column = named[inverse]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = max(256, min(8192, 4_000_000 // max(n, 1)))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    linked = shared >= similarity * union - 1e-6
    if not same:
        linked &= blk[:, None] != blk[None, :]
    np.fill_diagonal(linked, False)
    root, count = np.arange(n), linked.astype(np.float64) @ weight
    if linked.any():
        i, j = np.nonzero(np.triu(linked))
        root = local_forest(i, j, n)
    return count.astype(np.int64), root


def near_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                   target_recall: float = TARGET_RECALL, bucket_block: int = BUCKET_BLOCK, verify_rows: int = VERIFY_ROWS,
                   verify_runs: int = VERIFY_RUNS) -> DataFrame:
    """One row per document row: ``doc_id, digest, class_id, class_digest, n_links``.

    ``class_id`` is the smallest id reachable over links and ``class_digest`` the smallest digest that has it, ``n_links`` the number of other rows at the
    similarity or above, copies included.
    """
    slim = write_shared(sketches(docs, doc_id, text))
    usable = slim.where("doc_id is not null and runs > 0")
    one = write_shared(usable.groupBy("fp1", "fp2").agg(
        F.min(F.struct("doc_id", "digest")).alias("node"), F.count("*").alias("w"), F.first("runs").alias("runs"),
        F.first("sig").alias("sig")))
    shortest = shortest_prefix(similarity, target_recall)
    least = similarity - 4 * float(np.sqrt(similarity * (1 - similarity) / (TREES * DEPTH)))

    # candidates: buckets of the shortest prefix
    entries = one.select("node", F.explode(F.array(*[F.struct(
        F.lit(t).alias("tree"), F.xxhash64(F.substring("sig", t * DEPTH + 1, shortest), F.lit(t)).alias("bucket"))
        for t in range(TREES)])).alias("x")).select("node", "x.tree", "x.bucket")
    full = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(full, "bucket").join(one.select("node", "sig"), "node")
    met = block_pairs(met, F.ceil(F.col("n") / bucket_block), F.col("node"))

    def forest():
        def run(t: pa.Table, at: np.ndarray) -> pa.Table:
            tree = t["tree"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
            us, vs = [], []
            for s, e in zip(at[:-1], at[1:]):
                k = tree[s] * DEPTH
                root = bucket_forest(sig[s:e], sig[s:e, k:k + DEPTH], shortest, least)
                moved = np.flatnonzero(root != np.arange(e - s))
                us.append(s + moved)
                vs.append(s + root[moved])
            return pa.table({"u": t["node"].take(pa.array(np.concatenate(us))), "v": t["node"].take(pa.array(np.concatenate(vs)))})
        return run

    near = clustered_map(met.select("bucket", "bi", "bj", "tree", "node", "sig"), ["bucket", "bi", "bj"],
                         f"u {NODE}, v {NODE}", forest)
    clusters = write_shared(components(near))
    inside = (one.select("node", "w", "runs")
              .join(clusters.select("node", F.col("component.doc_id").alias("c1"), F.col("component.digest").alias("c2")), "node"))
    sizes = inside.groupBy("c1", "c2").agg(F.count("*").alias("rows"), F.sum("runs").alias("all_runs"))
    inside = write_shared(inside.join(sizes, ["c1", "c2"]))

    # verification: every cluster's texts by pairs of blocks
    texts = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id"),
                                 F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest")).alias("node"),
                        F.col(text).alias("text"))
    rows = texts.join(maybe_broadcast(inside), "node")
    blocks = F.greatest(F.ceil(F.col("rows") / verify_rows), F.ceil(F.col("all_runs") / verify_runs))
    rows = block_pairs(rows, blocks, F.col("node"))

    def verify():
        def run(t: pa.Table, at: np.ndarray) -> pa.Table:
            nodes = t["node"].combine_chunks()
            node, digest = (c.to_numpy() for c in nodes.flatten())
            w, blk, bi, bj = (t[c].to_numpy() for c in ("w", "blk", "bi", "bj"))
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(at[:-1], at[1:]):
                _, first = np.unique(np.stack([node[s:e], digest[s:e]]), axis=1, return_index=True)  # repeated rows
                first = np.sort(first) + s
                if len(first) < 2:
                    continue
                sets = [run_set(x) for x in tokens(t["text"].take(pa.array(first)))]
                count, root = verify_block(sets, blk[first], w[first], similarity, bi[s] == bj[s])
                moved = np.flatnonzero(root != np.arange(len(first)))
                some = np.flatnonzero(count > 0)
                for o, v in zip(out, (np.concatenate([first[moved], first[some]]),
                                      np.concatenate([first[root[moved]], np.full(len(some), -1)]),
                                      np.concatenate([np.zeros(len(moved), np.int64), count[some]]))):
                    o.append(v)
            u, v, n = (np.concatenate([*o, np.zeros(0, np.int64)]) for o in out)
            return pa.table({"u": nodes.take(pa.array(u)), "v": nodes.take(pa.array(v, mask=v < 0)), "n": n})
        return run

    checked = write_shared(clustered_map(
        rows.select("c1", "c2", "bi", "bj", "blk", "node", "w", "text"), ["c1", "c2", "bi", "bj"],
        f"u {NODE}, v {NODE}, n long", verify))
    groups = components(checked.where("v is not null").select("u", "v"))
    counts = checked.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    named = (one.join(counts, "node", "left").select(
        "fp1", "fp2", "node", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"))
        .join(groups.withColumnRenamed("component", "c"), "node", "left")
        .select("fp1", "fp2", "n_links", F.coalesce("c", "node").alias("class")))
    linked = usable.select("doc_id", "digest", "fp1", "fp2").join(named, ["fp1", "fp2"]).select(
        "doc_id", "digest", F.col("class.doc_id").alias("class_id"), F.col("class.digest").alias("class_digest"), "n_links")
    alone = slim.where("doc_id is null or runs = 0").select(
        "doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies and its number of links."""
    return near_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
