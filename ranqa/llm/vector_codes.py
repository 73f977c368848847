"""Vector code compression: parts of a vector become indexes into small codebooks.

1. Entries become floor(256 * entry); a vector is cut into 16 equal parts (zeros fill a length that 16 does not divide).  Each
   part position has a codebook, which starts as that part of the 64 smallest ids' vectors.
2. Inside a task the distinct parts of a batch are sorted, which makes them a trie over their entries: rows with a common
   prefix are neighbours.  A depth-first traversal carries, for the node it is at, the squared distance of the prefix to every
   codebook entry; children add one dimension to their parent's vector, so a prefix is measured once however
   many parts share it.  At a leaf the vector is complete: its smallest place is the nearest entry and the part's count times its entries
   go into that entry's sum.  Subtrees of bounded size are taken at once, siblings together.
3. A round sends one sum per (part, entry, dimension) and task, added up in Spark; the new codebooks (64 times the vector length
   numbers) go back with the next round.  Vectors are never moved.
4. After the rounds one more pass writes code and error; errors are added up per label and joined to the rows.

Vectors of another length have their own codebooks (from their own 64 smallest ids) and digest; labels span all lengths.

Defined results: vectors that are null, hold null or non-finite entries or entries of absolute value 65,536 and more (their
squares leave the exact range) are dropped; the 64 first are taken by id and, for equal ids, by entries, null ids
last; fewer rows make a shorter codebook; empty vectors have the code of 16 zeros and no error; repeated rows are rows like
others; null labels count together; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.llm.common import BROADCAST_ROWS, table
from ranqa.llm.vectors import floors, lengths, usable
from ranqa.session import write_shared

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
ENTRY_BELOW = 65_536.0
#: leaves of a subtree that are measured at once
BLOCK = 2_048
#: copies of a label's sum in the shuffled join, so that a frequent label is spread
SALTS = 16


def split_parts(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width) of integer vectors, zeros added where the length needs them."""
    width = -(-x.shape[1] // parts)
    full = np.zeros((len(x), parts * width), np.int64)
    full[:, :x.shape[1]] = x
    return full.reshape(len(x), parts, width)


def distinct_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, place of each row among them, count of each)."""
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = x.min(axis=0)
    bits = [int(s).bit_length() for s in x.max(axis=0) - low]
    if sum(bits) <= 63:  # one number per row, in the same order
        key = np.zeros(len(x), np.int64)
        for k, b in enumerate(bits):
            key = (key << b) | (x[:, k] - low[k])
        _, first, place, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return x[first], place, count
    order = np.lexsort(x.T[::-1])
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[order[new]], place, np.bincount(place)


def nearest(parts: np.ndarray, book: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower, squared distance) of distinct ``parts`` in lexicographic order."""
    rows, width = parts.shape
    index, distance = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if not rows or not width:
        return index, distance
    new = np.ones(parts.shape, bool)  # the row begins a node of the level
    new[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    span = 2 * max(np.abs(parts).max(), np.abs(book).max())
    kind = float if float(span) ** 2 * width < 2.0 ** 53 else np.int64  # exact in both
    p, b = parts.astype(kind), book.astype(kind)

    def children(starts: np.ndarray, end: int, depth: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the nodes below and their accumulated distances."""
        lo = starts[0]
        below = lo + np.flatnonzero(new[lo:end, depth])
        parent = np.searchsorted(starts, below, "right") - 1
        step = p[below, depth][:, None] - b[None, :, depth]
        return below, sums[parent] + step * step

    # siblings: first rows, row after the last, depth, one distance vector each
    stack = [(np.zeros(1, np.int64), rows, 0, np.zeros((1, len(b)), kind))]
    while stack:
        starts, end, depth, sums = stack.pop()
        lo = starts[0]
        if depth == width or end - lo <= block:
            while depth < width:
                starts, sums = children(starts, end, depth, sums)
                depth += 1
            index[lo:end] = sums.argmin(axis=1)
            distance[lo:end] = sums[np.arange(len(sums)), index[lo:end]]
        elif len(starts) == 1:
            starts, sums = children(starts, end, depth, sums)
            stack.append((starts, end, depth + 1, sums))
        else:  # too many rows: the first siblings that fit, the others later
            ends = np.append(starts[1:], end)
            m = max(1, int(np.searchsorted(ends, lo + block, "right")))
            if m < len(starts):
                stack.append((starts[m:], end, depth, sums[m:]))
            stack.append((starts[:m], int(ends[m - 1]), depth, sums[:m]))
    return index, distance


def first_books(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width) codebooks of the smallest ids."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).select("e").collect()  # 64 rows
    x = np.floor(SCALE * np.array([r["e"] for r in head])).astype(np.int64).reshape(-1, d)
    return split_parts(x, parts).transpose(1, 0, 2)


def entry_sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the parts nearest to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x = split_parts(floors(b.column(0), SCALE), len(books)) if b.num_rows else np.zeros((0, *books.shape[::2]), np.int64)
            for k, book in enumerate(books):
                own, _, count = distinct_parts(x[:, k])
                at, _ = nearest(own, book)
                np.add.at(total[k], at, own * count[:, None])
                np.add.at(number[k], at, count)
        part, entry = np.nonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
             pa.array(np.column_stack([number[part, entry], total[part, entry]]).tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "s"])

    each = rows.select("e").mapInArrow(run, "part int, entry int, s array<long>").select(
        "part", "entry", F.posexplode("s").alias("i", "s"))
    total, number = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for r in each.groupBy("part", "entry", "i").agg(F.sum("s").alias("s")).collect():  # one number per codebook entry's dimension
        if r["i"]:
            total[r["part"], r["entry"], r["i"] - 1] = r["s"]
        else:
            number[r["part"], r["entry"]] = r["s"]
    return total, number


def fit_books(rows: DataFrame, d: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning every part and taking the floors of the means; unused entries stay."""
    books = first_books(rows, d)
    for _ in range(rounds):
        total, number = entry_sums(rows, books)
        books = np.where(number[:, :, None] > 0, total // np.maximum(number, 1)[:, :, None], books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def hex_codes(index: np.ndarray) -> pa.Array:
    """Two hex digits per part of (rows, parts) indexes."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    text = np.stack([digits[index >> 4], digits[index & 15]], axis=2).reshape(len(index), -1)
    offsets = np.arange(len(index) + 1, dtype=np.int32) * text.shape[1]
    return pa.StringArray.from_buffers(len(index), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of the vectors ``e`` of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            index, error = np.zeros((b.num_rows, len(books)), np.int64), np.zeros(b.num_rows, np.int64)
            if books.shape[2]:
                x = split_parts(floors(b.column(2), SCALE), len(books))
                for k, book in enumerate(books):
                    own, place, _ = distinct_parts(x[:, k])
                    at, distance = nearest(own, book)
                    index[:, k] = at[place]
                    error += distance[place]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hex_codes(index), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    label = rows.schema["more0"].dataType.simpleString()
    return rows.select("vec_id", F.col("more0").alias("label"), "e").mapInArrow(
        run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
             rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per kept vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    rows = usable(vectors, vec_id, embedding, ENTRY_BELOW, label)
    coded = None
    for d in lengths(rows):
        some = rows.where(F.col("d") == d)
        books = fit_books(some, d, rounds) if d else np.zeros((PARTS, 0, 0), np.int64)
        part = encode(some, books).withColumn("codebooks_sha256", F.lit(books_digest(books)))
        coded = part if coded is None else coded.unionByName(part)
    if coded is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = write_shared(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    same = F.col("label").eqNullSafe(F.col("l"))
    if sums.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = coded.join(F.broadcast(sums), same)
    else:
        spread = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(
            spread, same & (F.col("salt") == F.col("s")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and the error of its label."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql_assign(book: str) -> str:
    """Nearest entry of every part as (rid, p, k, dist)."""
    return f"""
  SELECT rid, p, best.k AS k, best.dist AS dist FROM (
    SELECT x.rid, x.p, min({{'dist': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.x, c.x)]), 'k': c.k}}) AS best
    FROM parts x JOIN {book} c ON c.p = x.p GROUP BY x.rid, x.p)"""


def _sql_next(book: str, assigned: str) -> str:
    return f"""
  SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM {book} c LEFT JOIN (
    SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS x FROM (
      SELECT a.p, a.k, j, sum(x.x[j + 1]) AS s, count(*) AS n
      FROM {assigned} a JOIN parts x ON x.rid = a.rid AND x.p = a.p, range(0, len(x.x)) AS r(j) GROUP BY a.p, a.k, j)
    GROUP BY p, k) m ON m.p = c.p AND m.k = c.k"""


#: for tables whose vectors all have one length that 16 divides
OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
parts AS MATERIALIZED (
  SELECT rid, vec_id, p, e[p * (len(e) // {PARTS}) + 1 : (p + 1) * (len(e) // {PARTS})] AS x FROM v, range(0, {PARTS}) AS r(p)),
c0 AS MATERIALIZED (
  SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {ENTRIES}),
a0 AS MATERIALIZED ({_sql_assign('c0')}),
c1 AS MATERIALIZED ({_sql_next('c0', 'a0')}),
a1 AS MATERIALIZED ({_sql_assign('c1')}),
c2 AS MATERIALIZED ({_sql_next('c1', 'a1')}),
a2 AS MATERIALIZED ({_sql_assign('c2')}),
coded AS (
  SELECT v.vec_id, v.label, a.code, CAST(a.error AS BIGINT) AS error FROM v JOIN (
    SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(dist) AS error FROM a2 GROUP BY rid) a ON a.rid = v.rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256
FROM coded
"""
