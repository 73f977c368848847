"""Best-fit packing by exact-complement hashing over the histogram of lengths.

1. Tokenise every document inside tasks and cut it into pieces of at most
   ``capacity`` tokens (only longer documents are cut; the remainder is the first piece).
2. Count pieces per length: ``capacity`` numbers at most, whatever the input.
3. Plan on these counts: single, pair and triple sums of available lengths are looked up
   by the gap that a piece leaves; combinations that fill it exactly are consumed
   as often as the counts allow, longest pieces first.  What stays is packed best-fit decreasing.  The plan with the fewest
   sequences over a few settings is taken: a list of rank intervals per length, bounded by the number of lengths.
4. Every piece gets its rank among the pieces of its length (ranked in hash slots, so a
   frequent length is spread over tasks) and reads its place from the interval that holds the rank.

Ids are those of ``tokenizers`` for the given file.  The equivalent rank file is encoded by
``tiktoken`` (same ids, four times the speed) for texts whose characters both
regex engines classify alike (below U+0250); other texts, and texts that
hold the end-of-text string, go through ``tokenizers`` itself.

Defined results: null text counts as empty (one piece holding only the end id); a
null doc_id is kept; repeated rows are packed each; an empty table gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ranqa.llm.common import shuffle_partitions, table
from ranqa.session import write_shared

CAPACITY, END_ID = 1024, 2
#: (lengths that may fill a gap exactly, least length in pairs and triples as a share of the capacity); the last is plain best fit
ATTEMPTS = [(3, 0), (3, 1 / 32), (3, 1 / 8), (2, 0), (2, 1 / 8), (1, 0), (0, 0)]
#: rows that one slot of a length holds on average
SLOT_ROWS = 200_000


@lru_cache(maxsize=4)
def encoder(tokenizer_json: str, ranks: str | None, pattern: str | None):
    """text -> token ids, built once per worker process."""
    full: list = []

    def exact(text: str) -> list[int]:
        if not full:  # loaded by workers that meet such a text only
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(tokenizer_json))
        return full[0].encode(text, add_special_tokens=False).ids

    if not ranks:
        return exact
    import tiktoken

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
    with open(tokenizer_json, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    other = re.compile("[^\u0000-\u024f]" + "".join("|" + re.escape(s) for s in special))
    return lambda text: exact(text) if other.search(text) else fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full pieces after the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_json: str, ranks: str | None = None, pattern: str | None = None,
           doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json, ranks, pattern)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(cols, (d, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals ``(length, first rank, n, first sequence, offset)``: the piece of ``length`` with rank
    ``first rank + i`` is in sequence ``first sequence + i`` at ``offset``.

    Pairs and triples may spend short lengths that best fit needs later, so the plan is made with the settings of
    ``ATTEMPTS`` and the one of fewest sequences is taken (of equal ones the first); the last setting is plain best-fit
    decreasing, so the plan never uses more sequences than that.  Works on counts only, in time bounded by the capacity.
    """
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best, fewest = [], None
    for members, share in ATTEMPTS:
        out, n = _plan(counts, capacity, members, int(share * capacity))
        if fewest is None or n < fewest:
            best, fewest = out, n
        if fewest <= bound:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, members: int, least: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rank intervals, sequences) when gaps are filled exactly by up to ``members`` lengths, in pairs and triples of at least
    ``least`` each."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    used = np.zeros(capacity + 1, np.int64)
    groups: list[tuple[int, tuple]] = []  # (bins, ((length, first rank, offset), ...))

    def take(combo: tuple[int, ...], m: int) -> tuple:
        """Slots of ``m`` bins that hold ``combo`` each."""
        slots, at = [], 0
        for n in combo:
            slots.append((n, int(used[n]), at))
            used[n] += m
            left[n] -= m
            at += n
        return tuple(slots)

    def most(combo: tuple[int, ...]) -> int:
        return min(int(left[n]) // combo.count(n) for n in combo)

    def pair(gap: int, below: int) -> tuple[int, int] | None:
        """The available pair that sums to ``gap``, longest first member."""
        if gap < 2:
            return None
        hi = np.arange(min(gap - 1, below), (gap - 1) // 2, -1)
        lo = gap - hi
        ok = hi[(left[hi] > 0) & (left[lo] > 0) & ((hi != lo) | (left[hi] > 1)) & (lo >= least)]
        return (int(ok[0]), gap - int(ok[0])) if len(ok) else None

    def fill(a: int) -> tuple[int, ...] | None:
        """A combination of available lengths that complements ``a`` exactly."""
        gap = capacity - a
        left[a] -= 1
        try:
            if left[gap] > 0:
                return (gap,)
            if members > 1 and (p := pair(gap, gap)):
                return p
            for b in range(gap - 2, max(least, 1) - 1, -1) if members > 2 else ():
                if left[b] > 0:
                    left[b] -= 1
                    p = pair(gap - b, min(b, gap - b))
                    left[b] += 1
                    if p:
                        return (b, *p)
            return None
        finally:
            left[a] += 1

    if left[capacity]:
        groups.append((m := int(left[capacity]), take((capacity,), m)))
    for a in range(capacity - 1, 0, -1) if members else ():
        while left[a] > 0 and (rest := fill(a)):
            m = most((a, *rest))
            groups.append((m, take((a, *rest), m)))

    open_: dict[int, list[tuple[int, tuple]]] = {}  # gap -> groups
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            gap = min((g for g, bins in open_.items() if g >= n and bins), default=None)
            if gap is None:
                each = min(capacity // n, int(left[n]))
                m = int(left[n]) // each
                open_.setdefault(capacity - each * n, []).append((m, take((n,) * each, m)))
                continue
            bins, slots = open_[gap].pop()
            m = min(bins, int(left[n]))
            if m < bins:
                open_[gap].append((bins - m, tuple((k, r + m, o) for k, r, o in slots)))
            (_, first, _), = take((n,), m)
            open_.setdefault(gap - n, []).append((m, (*slots, (n, first, capacity - gap))))
    groups += [g for gs in open_.values() for g in gs]

    out, seq = [], 0
    for bins, slots in groups:
        out += [(k, r, bins, seq, o) for k, r, o in slots]
        seq += bins
    return out, seq


def pack(found: DataFrame, capacity: int = CAPACITY, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``found`` (a stored table of pieces) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    intervals = spark.createDataFrame(plan(counts, capacity),
                                      "p_length long, p_rank long, p_n long, p_seq long, p_offset long")
    slots = max(shuffle_partitions(spark), -(-total // slot_rows))
    keyed = found.withColumn("__slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)))
    per_slot = keyed.groupBy("length", "__slot").agg(F.count("*").alias("__n"))
    base = per_slot.select("length", "__slot", (F.sum("__n").over(
        Window.partitionBy("length").orderBy("__slot")) - F.col("__n")).alias("__base"))
    order = Window.partitionBy("length", "__slot").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (keyed.withColumn("__row", F.row_number().over(order) - 1).join(base, ["length", "__slot"])
              .withColumn("__rank", F.col("__base") + F.col("__row")))
    placed = ranked.join(F.broadcast(intervals),  # bounded by the number of lengths
                         (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("p_rank"))
                         & (F.col("__rank") < F.col("p_rank") + F.col("p_n")))
    return placed.select(*found.columns, (F.col("p_seq") + F.col("__rank") - F.col("p_rank")).alias("sequence_id"),
                         F.col("p_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str | None = None, ranks: str | None = None,
                   pattern: str | None = None, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack ``docs``; without paths, the installed public tokenizer files are used."""
    if tokenizer_json is None:
        import public_tokenizers as P

        tokenizer_json, ranks, pattern = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    found = write_shared(pieces(docs, tokenizer_json, ranks, pattern, doc_id, text, capacity, end_id))
    return pack(found, capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
