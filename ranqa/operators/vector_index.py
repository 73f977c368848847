"""Inverted-file vector index: cosine top-k of many queries against a whole vector table.

``build_index`` clusters a bounded sample into cells, assigns every vector to the cell of its nearest centre and
writes the vectors as Parquet partitioned by cell, with one row per cell beside them (centre, size, widest angle).
``search`` deals queries to their ``n_probe`` nearest cells, compares them there in blocks of bounded size, keeps
the best ``k`` per query and block and merges these.  With ``exact=True`` every query is then compared with each cell
that can hold a better vector: one within angle ``r`` of its centre has at most cosine ``cos(max(0, angle(q, centre) - r))``.
Any share of the cells may be such, so blocks of queries and members meet in a cross join that reads them again and moves none.

A cell (or a query's cell) may hold any share of the rows: its vectors and its visitors are dealt into blocks by
hash, a task holds one pair of blocks.  No pairs leave a task but the best ``k`` per query.

Vectors that are null, empty, zero or hold null or non-finite entries, or have another length than the index, have no
direction and are neither found nor answered; scores are rounded to nine digits before they are ranked, equal ones by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranqa.session import write_shared

SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 20_000, 1_000, 4_096
MEMBER_BLOCK, QUERY_BLOCK = 4_096, 4_096
#: parts that the members are dealt into when all of them may be asked; a task holds one of them (Spark spills it) and a block of queries
SHARES = 16
DIGITS = 9
#: files that a cell's vectors are spread over at least, per ``MEMBER_BLOCK`` rows
_FOUND = "query long, id long, score double"


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that have a direction, ``v`` in doubles scaled to length 1."""
    e = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = e.where(F.col("e").isNotNull() & fine).withColumn("top", F.array_max(F.transform("e", F.abs))).where("top > 0")
    # in numpy: as expressions, the length would be worked out again for every entry
    return top.select("id", "e", "top").mapInArrow(_scaled, "id long, v array<double>")


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        e = b.column(1)
        counts = np.diff(e.offsets.to_numpy())
        flat = e.flatten().to_numpy() / np.repeat(b.column(2).to_numpy(), counts)  # squares cannot overflow
        first = np.concatenate([[0], np.cumsum(counts)])
        size = np.sqrt(np.add.reduceat(flat * flat, first[:-1])) if len(flat) else np.ones(0)
        v = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat / np.repeat(size, counts)))
        yield pa.RecordBatch.from_arrays([b.column(0), v], names=["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usual_length(rows: DataFrame) -> int:
    """The most frequent vector length (of equal ones the smaller), 0 for an empty table."""
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def _centres(rows: DataFrame, n: int, n_cells: int | None, sample_rows: int, seed: int) -> np.ndarray:
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = rows.where(part) if n > sample_rows else rows
    k = n_cells or max(1, min(MAX_CELLS, -(-n // CELL_ROWS)))
    if k == 1:
        return np.zeros((1, rows.first()["v"].__len__()))
    model = KMeans(k=k, maxIter=8, seed=seed, distanceMeasure="cosine", featuresCol="f").fit(
        sample.select(array_to_vector("v").alias("f")))
    return np.array(model.clusterCenters())


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def build_index(vectors: DataFrame, path: str, *, id_col: str = "id", vec_col: str = "embedding", n_cells: int | None = None,
                sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> None:
    """Write the index of ``vectors`` under ``path``: ``cells`` (Parquet partitioned by cell) and ``centres``.

    The sample that places the centres is bounded by ``sample_rows`` (about); every vector is indexed.
    """
    spark = vectors.sparkSession
    every = unit_vectors(vectors, id_col, vec_col)
    d = _usual_length(every)
    rows = every.where(F.size("v") == d)
    n = rows.count()
    if not n:
        spark.createDataFrame([], "id long, v array<double>, cell int").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([], "cell int, n long, radius double, centre array<double>").write.mode("overwrite").parquet(
            f"{path}/centres")
        return
    centres = _units(_centres(rows, n, n_cells, sample_rows, seed))
    shared = spark.sparkContext.broadcast(centres)  # MAX_CELLS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dots = _matrix(b.column(1)) @ shared.value.T
                cell = dots.argmax(axis=1)
                angle = np.arccos(dots[np.arange(len(cell)), cell].clip(-1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)],
                                                 names=["id", "v", "cell", "angle"])

    placed = write_shared(rows.mapInArrow(assign, "id long, v array<double>, cell int, angle double"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    found = {r["cell"]: (r["n"], r["radius"]) for r in sizes.collect()}  # one row per cell
    spark.createDataFrame([(c, n, r, centres[c].tolist()) for c, (n, r) in sorted(found.items())],
                          "cell int, n long, radius double, centre array<double>").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/centres")
    # a large cell is written by several tasks
    spread = F.broadcast(spark.createDataFrame([(c, -(-n // (8 * MEMBER_BLOCK))) for c, (n, _) in found.items()], "c int, s long"))
    dealt = placed.join(spread, F.col("cell") == F.col("c")).repartition("cell", F.pmod(F.xxhash64("id"), F.col("s")))
    dealt.select("id", "v", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding",
           n_probe: int = 8, exact: bool = False, keep_self: bool = False, member_block: int = MEMBER_BLOCK,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` vectors of largest cosine per query.

    A query's own id is left out unless ``keep_self``.  Without ``exact`` only the ``n_probe`` nearest cells are seen.
    """
    cells = [(r["cell"], r["n"], r["radius"], r["centre"])
             for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]  # MAX_CELLS rows at most
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    shared = spark.sparkContext.broadcast((np.array([c[0] for c in cells]), np.array([c[2] for c in cells]),
                                           np.array([c[3] for c in cells])))
    asked = write_shared(unit_vectors(queries, id_col, vec_col).where(F.size("v") == len(cells[0][3]))
                         .dropDuplicates(["id"]))
    probe = len(cells) if exact and len(cells) <= n_probe else n_probe
    first = _best(spark, path, _visits(asked, shared, probe), cells, k, keep_self, member_block, query_block)
    if exact and probe < len(cells):
        least = _rank(first, k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("low"))
        wider = asked.join(least, F.col("id") == F.col("query"), "left").select(
            "id", "v", F.col("low").alias("least"))
        first = _wide(spark, path, wider, shared, k, keep_self, member_block, query_block)
    return _rank(first, k).select(F.col("query").alias("query_id"), "rank", "id", "score")


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query; the filter on ``row_number`` runs before the shuffle too."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(asked: DataFrame, shared, n_probe: int) -> DataFrame:
    """Queries with each cell that they visit: the ``n_probe`` nearest ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, centres = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                dots = (_matrix(part.column(1)) @ centres.T).clip(-1, 1)
                near = np.argsort(-dots, axis=1, kind="stable")[:, :n_probe]
                row, col = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(ids[col], pa.int32())],
                    names=["id", "v", "cell"])

    return asked.mapInArrow(run, "id long, v array<double>, cell int")


_BLOCK = "ids binary, vectors binary, other binary"


def _blocks(rows: DataFrame, other: str, kind: type, size: int) -> DataFrame:
    """Up to ``size`` rows of a partition as one row: ids, vectors and the column ``other`` as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                more = part.column(2).to_numpy(zero_copy_only=False).astype(kind)
                packed = (part.column(0).to_numpy().tobytes(), _matrix(part.column(1)).tobytes(), more.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["ids", "vectors", "other"])

    return rows.select("id", "v", other).mapInArrow(run, _BLOCK)


def _wide(spark: SparkSession, path: str, wider: DataFrame, shared, k: int, keep_self: bool, member_block: int,
          query_block: int) -> DataFrame:
    """Per query and share of the cells, the best ``k`` of those vectors that reach ``least`` (null: all) as ``query, id, score``.

    Every block of queries meets every block of members, and is compared with those cells of it that can hold a vector as
    good as ``least``.  Blocks are read again for each meeting and not shuffled; the members are in ``SHARES`` shares
    whatever their number, so what is moved grows with the queries.
    """
    members = write_shared(_blocks(spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/cells"), "cell",
                                   np.int32, member_block).repartition(SHARES))
    queries = write_shared(_blocks(wider, "least", float, query_block))
    pairs = queries.toDF("q_ids", "q_vectors", "q_least").hint("shuffle_replicate_nl").crossJoin(members.coalesce(SHARES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radius, centres = shared.value
        last, near, kept = None, None, None
        for b in batches:
            for row in range(b.num_rows):
                mine, q, least, theirs, y, cell = (np.frombuffer(c[row].as_buffer(), t) for c, t in
                                                   zip(b.columns, (np.int64, float, float, np.int64, float, np.int32)))
                q, y = q.reshape(len(mine), -1), y.reshape(len(theirs), -1)
                if last is None or not np.array_equal(mine, last):  # the blocks of a share meet one block of queries after the other
                    if kept is not None:
                        yield kept.best()
                    last, kept = mine.copy(), _Kept(mine.copy(), least, k)
                    most = np.cos(np.maximum(np.arccos((q @ centres.T).clip(-1, 1)) - radius, 0))
                    near = np.isnan(least)[:, None] | (most >= least[:, None] - 1e-7)
                for c in np.unique(cell):
                    inside, asking = np.flatnonzero(cell == c), np.flatnonzero(near[:, np.searchsorted(cells, c)])
                    x, ids = y[inside].T, theirs[inside]
                    for at in range(0, len(asking), 256):
                        some = asking[at:at + 256]
                        s = np.round(q[some] @ x, DIGITS) + 0.0
                        if not keep_self:
                            s[mine[some, None] == ids[None, :]] = -np.inf
                        r, col = np.nonzero((s >= kept.low[some, None]) & (s > -np.inf))
                        kept.add(some[r], ids[col], s[r, col])
        if kept is not None:
            yield kept.best()

    return pairs.mapInArrow(run, _FOUND)


class _Kept:
    """The best ``k`` so far per query of a block; ``low`` is the score that a further one must reach."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.low = np.where(np.isnan(least), -np.inf, least - 10.0 ** -(DIGITS - 1))
        self.found, self.n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((row, ids, score))
        self.n += len(row)
        if self.n > 4 * self.k * len(self.ids) + 100_000:
            self._cut()

    def _cut(self) -> None:
        row, ids, score = (np.concatenate(c) for c in zip(*self.found))
        by = np.lexsort((ids, -score, row))
        row, ids, score = row[by], ids[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = rank == self.k - 1
        self.low[row[full]] = np.maximum(self.low[row[full]], score[full])
        top = rank < self.k
        self.found, self.n = [(row[top], ids[top], score[top])], int(top.sum())

    def best(self) -> pa.RecordBatch:
        self._cut()
        row, ids, score = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(ids), pa.array(score)], names=["query", "id", "score"])


def _best(spark: SparkSession, path: str, visits: DataFrame, cells: list, k: int, keep_self: bool, member_block: int,
          query_block: int) -> DataFrame:
    """The best ``k`` per query and pair of blocks as ``query, id, score``."""
    visits = write_shared(visits)
    guests = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    plan = spark.createDataFrame([(c, -(-n // member_block), -(-guests[c] // query_block)) for c, n, *_ in cells if c in guests],
                                 "c int, mb long, qb long")

    def spread(col: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(col))

    def all_of(col: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))

    members = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/cells").join(
        F.broadcast(plan), F.col("cell") == F.col("c")).select(
        "cell", spread("mb", 1).alias("m"), all_of("qb").alias("q"), F.lit(True).alias("member"), "id", "v")
    asking = visits.join(F.broadcast(plan), F.col("cell") == F.col("c")).select(
        "cell", all_of("mb").alias("m"), spread("qb", 2).alias("q"), F.lit(False).alias("member"), "id", "v")

    def compare(t: pa.Table) -> pa.Table:
        member = t["member"].to_numpy()
        ids = t["id"].to_numpy()
        out_q, out_i, out_s = [], [], []
        if member.any() and not member.all():
            x = _matrix(t["v"])
            mine, theirs = ids[~member], ids[member]
            order = np.argsort(theirs, kind="stable")
            theirs, y = theirs[order], x[member][order].T
            q = x[~member]
            for at in range(0, len(mine), 256):
                s = np.round(q[at:at + 256] @ y, DIGITS) + 0.0
                if not keep_self:
                    s[mine[at:at + 256, None] == theirs[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k] if s.shape[1] <= 4 * k else _largest(s, k)
                row = np.repeat(np.arange(len(s)), top.shape[1])
                value = s[row, top.ravel()]
                ok = value > -np.inf
                out_q.append(mine[at:at + 256][row[ok]])
                out_i.append(theirs[top.ravel()[ok]])
                out_s.append(value[ok])
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return pa.table({"query": join(out_q, np.int64), "id": join(out_i, np.int64), "score": join(out_s, float)})

    return members.unionByName(asking).groupBy("cell", "m", "q").applyInArrow(compare, _FOUND)


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest entries of every row, equal entries by the smaller column."""
    bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    out = np.empty((len(s), k), np.int64)
    for i in range(len(s)):
        some = np.flatnonzero(s[i] >= bound[i])
        out[i] = some[np.argsort(-s[i, some], kind="stable")[:k]]
    return out
