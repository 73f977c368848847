"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that a Python function gets at once: what it makes from them stays small.
SLICE_ROWS = 2_000

# A side is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row as ``(id, text digest)``.

    Ids may repeat or be null: rows that share an id but not a text stay
    apart, rows that repeat both are interchangeable.
    """
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"),
                    F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count shows it within ``bound`` rows; else leave the
    join to shuffles.  Both give the same rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (multiply and shift rounds)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def binary_views(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow array without copying; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64)


def free_name(wanted: str, *taken: DataFrame) -> str:
    """``wanted``, lengthened until no column of the given tables has that name (Spark compares without case)."""
    names = {c.lower() for df in taken for c in df.columns}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def append_columns(df: DataFrame, inputs: list[str], schema: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """``df`` plus the columns of ``schema`` in one pass without a shuffle.

    ``make()`` is called once per task and returns a function from the Arrow arrays of
    ``inputs`` to one Arrow array per new column.  Columns of ``df`` with a new column's name are replaced.
    """
    new = {c.lower() for c in schema.names}
    keep = [c for c in df.columns if c.lower() not in new]
    given = [F.col(f"`{c}`").alias(free_name(f"__in{i}", df)) for i, c in enumerate(inputs)]
    src = df.select(*given, *[F.col(f"`{c}`") for c in keep])
    out = T.StructType([*[df.schema[c] for c in keep], *schema.fields])
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[n:], *fn(*b.columns[:n])], names=out.names)

    return src.mapInArrow(run, out)


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n-1 modulo 2**64; the longest list so far is kept (up to a bound)."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, 4096), np.uint64(base))
        out[0] = 1
        known = np.multiply.accumulate(out, dtype=np.uint64)
        if len(known) <= 4_000_000:
            _POWERS[base] = known
    return known[:n]


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``n`` tokens (prefix sums modulo 2**64, then scrambled)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(BASE, len(tokens)), out=sums[1:], dtype=np.uint64)
    return mix64((sums[n:] - sums[:-n]) * powers(INVERSE, len(tokens))[: len(tokens) - n + 1])


_SPACE, _SIGN, _OTHER = 1, 0, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[i for i in range(128) if not chr(i).isalnum()]] = _SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


def tokens(texts: pa.Array, bare: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the lower-case words of every text, words being what ASCII white space separates.

    ``bare`` leaves out signs (ASCII characters that are neither letters nor digits) and words that hold
    nothing else.  Null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, off = binary_views(pc.utf8_lower(pc.fill_null(texts, "")))
    out: list[np.ndarray] = []
    first = 0
    while first < len(off) - 1:  # documents in groups of about a megabyte
        last = max(first + 1, int(np.searchsorted(off, off[first] + (1 << 20), "right")) - 1)
        out += _tokens_of(data[off[first]:off[last]], off[first:last + 1] - off[first], bare)
        first = last
    return out


def _tokens_of(b: np.ndarray, off: np.ndarray, bare: bool) -> list[np.ndarray]:
    kind = _CLASS[b]
    if bare:
        keep = kind != _SIGN
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        b, kind = b[keep], kind[keep]
    space = np.empty(len(b) + 2, bool)
    space[0] = space[-1] = True
    np.equal(kind, _SPACE, out=space[1:-1])
    starts = ~space[1:-1] & space[:-2]
    ends = space[2:] & ~space[1:-1]  # at the last byte of a word
    inner = off[(off > 0) & (off < len(b))]  # a document's end ends a word
    starts[inner] |= ~space[1:-1][inner]
    ends[inner - 1] |= ~space[1:-1][inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), out=sums[1:])
    h = mix64((sums[e] - sums[s]) * powers(INVERSE, len(b) + 1)[s])
    at = np.searchsorted(s, off)
    return [h[i:j] for i, j in zip(at[:-1], at[1:])]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int = 11,
                    doc_id: str = "doc_id") -> DataFrame:
    """The documents of at most ``max_rows`` labelled ids with their label in ``__label``.

    Ids are taken in the order of a keyed hash; ids labelled both ways or with null are left out.
    The bounded id list is broadcast, so documents are scanned without a shuffle.
    """
    ids = (labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).dropna()
           .groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__max"))
           .where("__label = __max").drop("__max")
           .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_rows))
    return docs.join(F.broadcast(ids), F.col(doc_id) == F.col("__id")).drop("__id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def clustered_map(df: DataFrame, keys: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Bring the rows of each key (integer columns) together, sorted, and map many groups per call.

    ``make()`` gives, once per task, a function of an Arrow table and its group bounds (positions
    where groups begin, with the end appended) that returns an Arrow table.  A call holds whole groups; the caller keeps
    groups bounded, see :func:`block_pairs`.
    """
    src = df.repartition(*keys).sortWithinPartitions(*keys)

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(len(t) - 1, 0), bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(t)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, held = make(), None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            at = bounds(t)
            held = t.slice(at[-2])  # the last group may go on
            if len(at) > 2:
                yield from fn(t.slice(0, at[-2]).combine_chunks(), at[:-1]).to_batches()
        if held is not None:
            yield from fn(held.combine_chunks(), np.array([0, len(held)])).to_batches()

    return src.mapInArrow(run, schema)


def block_pairs(df: DataFrame, blocks: Column, by: Column) -> DataFrame:
    """Rows of a group dealt into ``blocks`` blocks by the hash of ``by`` and copied to every pair of blocks.

    Adds ``blk`` (the row's block) and the pair ``bi <= bj``: the rows of one (group, bi, bj) are at most two
    blocks, and any two rows of a group meet in one pair.
    """
    dealt = df.withColumn("__nb", blocks.cast("int")).withColumn("blk", F.pmod(F.xxhash64(by), F.col("__nb")).cast("int"))
    both = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return both.select("*", F.least("blk", "__o").alias("bi"), F.greatest("blk", "__o").alias("bj")).drop("__nb", "__o")
