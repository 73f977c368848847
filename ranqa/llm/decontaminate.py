"""Benchmark decontamination by greedy string tiling.

Tokens are the words between white space, lower case, letters and digits only.  Documents and benchmark items are
joined on shared runs of ``MIN_MATCH`` tokens (the seeds).  Each joined pair is tiled: matches of at least ``s``
tokens are found by Karp-Rabin hashes of all runs of ``s`` unmarked tokens, checked token by token, extended, and
marked longest first without overlap; ``s`` then shrinks to ``MIN_MATCH``.  The share of the item's tokens under tiles
is its coverage, so a passage whose parts were reordered still counts.  A document is
contaminated when the coverage of an item reaches ``MIN_COVERAGE``.

The benchmark side is broadcast after its size was checked; beyond the bound seeds are joined by
shuffles (salted, so that a passage which many documents share is spread), with the same rows.  A pair whose seeds alone
cannot reach the coverage is not tiled.

Defined results: null and empty texts match nothing; items of fewer than ``MIN_MATCH`` tokens hold no seed and match
nothing; repeated items are matched each; repeated documents are judged each; empty tables give no
match or no row; all columns of the documents are carried through, those with a result's name (whatever its case) are replaced;
long texts of one repeated word are matched like others (pairs of equal starts are looked at in portions).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, free_name, rolling, row_key, table, tokens
from ranqa.session import write_shared

MIN_MATCH, MIN_COVERAGE = 5, 0.5
#: benchmark characters up to which the item side is broadcast
BROADCAST_CHARS = 16_000_000
#: pairs of equal starts that are looked at together
PAIRS = 1_000_000
#: copies of an item's seeds in the shuffled join, so that a frequent seed is spread
SALTS = 16

FOUND = T.StructType([T.StructField("n_items", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType())),
                      T.StructField("max_coverage", T.DoubleType()), T.StructField("contaminated", T.BooleanType())])


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray,
             s: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, doc start, item start) of at least ``s`` unmarked tokens."""
    hd, hi = rolling(doc, s), rolling(item, s)
    whole = lambda free: np.convolve(free, np.ones(s, np.int64), "valid") == s if len(free) >= s else free[:0]
    pd, pi = np.flatnonzero(whole(free_d)), np.flatnonzero(whole(free_i))
    pi = pi[np.argsort(hi[pi], kind="stable")]
    keys = hi[pi]
    lo, end = np.searchsorted(keys, hd[pd], "left"), np.searchsorted(keys, hd[pd], "right")
    out: list[tuple[int, int, int]] = []
    counts = np.cumsum(end - lo)
    at = 0
    while at < len(pd):  # equal starts in portions; a pair that the one before it extends into is inside that match
        stop = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + PAIRS, "right")))
        n = (end - lo)[at:stop]
        d = np.repeat(pd[at:stop], n)
        i = pi[np.repeat(lo[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        inside = (d > 0) & (i > 0)
        inside &= (doc[d - 1] == item[i - 1]) & (free_d[d - 1] > 0) & (free_i[i - 1] > 0)
        for x, y in zip(d[~inside].tolist(), i[~inside].tolist()):
            most = min(len(doc) - x, len(item) - y)
            same = (doc[x:x + most] == item[y:y + most]) & (free_d[x:x + most] & free_i[y:y + most]).astype(bool)
            size = most if same.all() else int(same.argmin())
            if size >= s:
                out.append((size, x, y))
        at = stop
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, doc start, item start), longest first."""
    free_d, free_i = np.ones(len(doc), np.int64), np.ones(len(item), np.int64)
    tiles, s = [], max(min_match, len(item) // 2)
    while True:
        found = _matches(doc, item, free_d, free_i, s)
        while found:  # mark the longest; what it cuts off is looked for again
            found.sort(key=lambda m: (-m[0], m[1], m[2]))
            n, d, i = found[0]
            if not (free_d[d:d + n].all() and free_i[i:i + n].all()):
                found = _matches(doc, item, free_d, free_i, s)
                continue
            free_d[d:d + n] = 0
            free_i[i:i + n] = 0
            tiles.append((n, d, i))
            found = found[1:]
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


class Items:
    """Benchmark items with their seeds sorted for lookups."""

    def __init__(self, rows: list[tuple[int, str | None]], min_match: int):
        self.ids = [i for i, _ in rows]
        self.tokens = tokens(pa.array([t for _, t in rows], pa.string()), bare=True)
        seeds = [rolling(t, min_match) for t in self.tokens]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in seeds])
        place = np.concatenate([*(np.arange(len(x)) for x in seeds), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner, self.place = flat[order], owner[order], place[order]
        # low bits of the seeds: most runs of a clean document end here
        self.low = np.uint64((1 << max(16, (8 * len(flat)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[(flat & self.low).astype(np.int64)] = True

    def coverage(self, doc: np.ndarray, min_match: int, min_coverage: float) -> list[tuple[int, float]]:
        """(item id, coverage) of the items that reach ``min_coverage`` in a document."""
        h = rolling(doc, min_match)
        h = np.unique(h[self.maybe[(h & self.low).view(np.int64)]])
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        n = hi - lo
        if not n.any():
            return []
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # places of the document's seeds among the items'
        at = at[np.argsort(self.owner[at], kind="stable")]
        owners, first = np.unique(self.owner[at], return_index=True)
        out = []
        for k, places in zip(owners, np.split(self.place[at], first[1:])):
            item = self.tokens[k]
            reach = np.zeros(len(item) + 1, np.int64)
            np.add.at(reach, places, 1)
            np.add.at(reach, places + min_match, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < min_coverage * len(item):
                continue  # even all seeds together stay below
            c = sum(n for n, _, _ in tile(doc, item, min_match)) / len(item)
            if c >= min_coverage:
                out.append((self.ids[k], c))
        return out


#: the items of the worker's latest call, by the call's token
_KNOWN: dict[str, Items] = {}


def _summary(found: list[list[tuple[int, float]]]) -> list[pa.Array]:
    return [pa.array([len(f) for f in found], pa.int64()),
            pa.array([sorted(i for i, _ in f) for f in found], pa.list_(pa.int64())),
            pa.array([max((c for _, c in f), default=0.0) for f in found], pa.float64()),
            pa.array([bool(f) for f in found], pa.bool_())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
                  min_coverage: float = MIN_COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``docs`` plus ``n_items``, ``item_ids`` (sorted), ``max_coverage`` and ``contaminated``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t") + 50), F.lit(0)).alias("n")).first()["n"]
    if chars <= broadcast_chars:
        rows = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in items.collect()])

        token = uuid.uuid4().hex

        def make():
            if token not in _KNOWN:  # once per worker, not per task
                _KNOWN.clear()
                _KNOWN[token] = Items(rows.value, min_match)
            known = _KNOWN[token]
            return lambda texts: _summary([known.coverage(t, min_match, min_coverage) for t in tokens(texts, bare=True)])

        return append_columns(docs, [text], FOUND, make)
    return _by_shuffles(docs, items, doc_id, text, min_match, min_coverage)


def _by_shuffles(docs: DataFrame, items: DataFrame, doc_id: str, text: str, min_match: int,
                 min_coverage: float) -> DataFrame:
    """The same for a benchmark of any size: seeds, then candidate pairs, joined by shuffles."""
    found_seeds = T.StructType([T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])

    def seeds_of():
        def run(texts: pa.Array) -> list[pa.Array]:
            words = tokens(texts, bare=True)
            return [pa.array([np.unique(rolling(t, min_match)).view(np.int64) for t in words], pa.list_(pa.int64())),
                    pa.array([len(t) for t in words], pa.int64())]
        return run

    # internal columns: the documents' own are joined to the result by the row's key only
    d = write_shared(append_columns(docs.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"),
                                                F.col(f"`{text}`").alias("doc_text")).dropDuplicates(["key"]), ["doc_text"],
                                    found_seeds, seeds_of))
    # an item is its text; how often it is repeated, and under which ids, joins at the end
    texts = items.select("t").distinct().withColumn("item", F.struct(F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(5)).alias("b")))
    i = append_columns(texts, ["t"], found_seeds, seeds_of)
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")
    left = d.select("key", salt, F.explode("seeds").alias("seed"))
    right = i.select("item", "n", F.explode("seeds").alias("seed")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a distinct seed lies at one place of the document at least and covers min_match words of the item: few seeds
    # cannot reach the coverage, unless the item repeats them
    pairs = left.join(right, ["seed", "salt"]).groupBy("key", "item", "n").agg(F.count("*").alias("met"))
    repeats = append_columns(i.select("item", "t"), ["t"], T.StructType([T.StructField("most", T.LongType())]),
                             lambda: _most_repeated(min_match)).select("item", "most")
    pairs = pairs.join(repeats, "item").where(F.col("met") * F.col("most") * min_match >= min_coverage * F.col("n"))
    both = pairs.select("key", "item").join(i.select("item", "t"), "item").join(d.select("key", "doc_text"), "key")
    cover = T.StructType([T.StructField("c", T.DoubleType())])

    def tiles():
        def one(item: str, doc: np.ndarray) -> float:
            f = Items([(0, item)], min_match).coverage(doc, min_match, min_coverage)
            return f[0][1] if f else 0.0

        return lambda ts, ds: [pa.array([one(a.as_py(), b) for a, b in zip(ts, tokens(ds, bare=True))], pa.float64())]

    named = items.groupBy("t", "i").agg(F.count("*").alias("times")).groupBy("t").agg(
        F.sum("times").alias("times"), F.sort_array(F.flatten(F.collect_list(F.array_repeat("i", F.col("times").cast("int")))))
        .alias("ids"))
    found = (append_columns(both, ["t", "doc_text"], cover, tiles).where(F.col("c") >= min_coverage).select("key", "t", "c")
             .join(named, "t").groupBy(F.col("key").alias("found_key")).agg(
                 F.sum("times").alias("found_n"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("found_ids"),
                 F.max("c").alias("found_c")))
    mine = {c: free_name(c, docs) for c in found.columns}
    found = found.select(*[F.col(c).alias(mine[c]) for c in found.columns])
    new = {c.lower() for c in FOUND.names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    out = docs.join(found, row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")) == F.col(mine["found_key"]), "left")
    n, ids, c = (F.col(mine[x]) for x in ("found_n", "found_ids", "found_c"))
    return out.select(*kept, F.coalesce(n, F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce(ids, F.array().cast("array<long>")).alias("item_ids"),
                      F.coalesce(c, F.lit(0.0)).alias("max_coverage"), n.isNotNull().alias("contaminated"))


def _most_repeated(min_match: int):
    """Texts -> how often the most frequent seed of each stands in it."""
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([int(np.unique(rolling(t, min_match), return_counts=True)[1].max(initial=0)) for t in tokens(texts, bare=True)],
                         pa.int64())]
    return run


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items whose tokens it covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_items", "item_ids", "max_coverage", "contaminated")
