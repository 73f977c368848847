"""Connected components of a link table, and the same within one block in numpy.

Spark part: alternating large-star / small-star rounds.  Every round is two
aggregations over the links; each node's neighbourhood is only folded to its
minimum and then rewired, so a hub's links are never gathered in one task
(the minimum is a partial aggregate and the rewiring a join that AQE may split).
Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranqa.session import write_shared


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        live = lo != hi
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(root, hi[live], lo[live])
        while True:  # pointer jumping
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
    return root


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on directed rows (u, v): join every neighbour to u's smallest neighbour."""
    both = (edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large
            else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    # stored, so the join below has plain exchanges on both sides and a hub's partition can be split
    low = write_shared(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    near = both.join(low, "u")
    if large:  # neighbours larger than u point to the smallest
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours point to the smallest
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) -> (node, component): the smallest node reachable, for each linked node.

    Self links and repeated links are allowed; an empty table gives none.
    Nodes may be any orderable type.
    """
    cur = write_shared(edges.select("u", "v").where("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        cur = write_shared(_star(_star(cur, True), False))
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        last = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
