"""Exact substring dedup with a distributed sparse suffix array.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes.  Only some suffixes need
sorting:

* In every window of ``length`` bytes the run of ``GRAM`` bytes with the smallest hash (rightmost of equals) is the window's
  anchor.  Equal windows have the anchor at the same place, so each window belongs to one anchor and a repeated window
  is found among the suffixes that start at anchors with equal runs.  Anchors are about one in
  ``(length - GRAM) / 2`` bytes.
* An anchor owns consecutive windows; its context is their union.  Anchors whose run occurs once are
  dropped by a pre-aggregated count.  Contexts that occur twice (by 128 bits, pre-aggregated) are covered as a whole, and one of
  each represents them.
* The remaining suffixes carry their contexts, are dealt by sampled splitters of their leading bytes
  (``repartitionByRange``; equal runs stay together) and sorted within each range by multikey
  quicksort, to the right from the anchor and, reversed, to the left.  With the common prefix lengths of
  neighbours, window ``d`` bytes before the anchor is repeated where a suffix shares ``length - d`` bytes to the right and
  ``d`` to the left with another one.
* Runs that more than ``hot_rows`` different contexts hold would fill one range: their windows are compared across ranges by
  digests of the whole window, pre-aggregated, which gives the same windows.

``shared_runs`` finds shorter passages by the same anchors over words: runs of more than ``WORDS`` words that another document
holds too.  They are counted, not removed.

Defined results: null text is empty; texts shorter than ``length`` keep all; rows that repeat (id, text) are copies of each
other; a null id is kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import BASE, INVERSE, append_columns, binary_views, mix64, powers, table
from ranqa.session import write_shared

LENGTH, HOT_ROWS = 400, 20_000
WORDS = 50                 # a passage has more words than these
GROUP_ROWS = 4_000         # suffixes that are sorted at once, or those of one run
SEGMENT = 1 << 16          # window starts that are handled at once
BASE2 = 0xC2B2AE3D27D4EB4F  # of the second hash
INVERSE2 = pow(BASE2, -1, 1 << 64)
_LOW = 20                  # bits of a sort key that hold the place in a segment


def gram_of(length: int) -> int:
    """Bytes of an anchor's run: about a third of the string."""
    return max(1, length * 8 // 25)


def _hashes(b: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums whose differences, times a power of the inverse, hash any stretch."""
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(base, len(b)), out=sums[1:])
    return sums


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of one text: (place, first owned window, windows owned, run hash, context hash).

    A long run of windows is handled in segments; an anchor whose windows lie in two gives two rows, which is
    harmless: windows stay with their anchor.
    """
    gram, out = gram_of(length), []
    span = length - gram + 1  # runs in a window
    for s in range(0, len(data) - length + 1, SEGMENT):
        b = data[s:s + SEGMENT + length - 1]
        one, two = _hashes(b, BASE), _hashes(b, BASE2)
        runs = len(b) - gram + 1
        h = mix64((one[gram:] - one[:-gram]) * powers(INVERSE, runs))
        # smallest hash first, rightmost of equals: the place counts down in the low bits
        key = (h >> np.uint64(_LOW) << np.uint64(_LOW)) | (np.uint64((1 << _LOW) - 1) - np.arange(runs, dtype=np.uint64))
        low, width = key, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        count = np.diff(np.append(first, len(low)))
        place = ((1 << _LOW) - 1) - (low[first] & np.uint64((1 << _LOW) - 1)).astype(np.int64)
        end = first + count - 1 + length
        context = mix64((two[end] - two[first]) * powers(INVERSE2, len(b) + 1)[first])
        out.append((place + s, first + s, count, h[place], context))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (columns: eight bytes each, big-endian), by three-way partitioning.

    All groups that agree so far are partitioned by their next word at once; rows that are alone or
    settled are not looked at again.
    """
    n = len(words)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by position: first position of the group
    live = np.arange(n)            # positions whose group has more than one row
    for depth in range(words.shape[1]):
        if len(live) < 2:
            break
        w = words[order[live], depth]
        by = np.lexsort((w, group[live]))
        order[live] = order[live][by]
        w, g = w[by], group[live]
        new = np.empty(len(live), bool)
        new[0] = True
        new[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(live)))
        group[live] = np.repeat(live[starts], sizes)
        live = live[np.repeat(sizes > 1, sizes)]
    return order


def _padded(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on (``step`` -1: to the left), zero beyond ``size``."""
    out = np.zeros((len(start), width), np.uint8)
    col = np.arange(width)
    for at in range(0, len(start), 256):  # the indexes take eight bytes for each byte
        s, n = start[at:at + 256, None], size[at:at + 256, None]
        out[at:at + 256] = np.where(col < n, data[np.minimum(np.maximum(s + step * col, 0), len(data) - 1)], 0)
    return out


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix length with the row before) of byte rows."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    order = multikey_quicksort(wide.view(">u8").astype(np.uint64))
    common = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 4096):
        a, b = rows[order[at - 1:at + 4095]], rows[order[at:at + 4096]]
        differs = a[:len(b)] != b
        common[at:at + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, common


def repeated_windows(data: np.ndarray, start: np.ndarray, before: np.ndarray, windows: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) distance to the anchor of the repeated windows of each context; largest -1: none.

    Context i begins at ``start[i]`` in ``data``; its anchor is ``before[i]`` bytes on, and it owns ``windows[i]``
    windows, the first at its beginning.
    """
    n = len(start)
    least = before - windows + 1  # distance of the last window
    right = _padded(data, start + before, length - least, length)
    left = _padded(data, start + before - 1, before, max(int(before.max(initial=0)), 1), -1)
    r_order, r_common = _ordered(right)
    l_order, l_common = _ordered(left)
    lo, hi = np.full(n, length), np.full(n, -1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(least.min(initial=0)), int(before.max(initial=-1)) + 1):
        # classes of rows that share enough to the right, and to the left
        r_class[r_order] = np.cumsum(r_common < length - d)
        l_class[l_order] = np.cumsum(l_common < d)
        own = np.flatnonzero((before >= d) & (least <= d))
        many = np.bincount(r_class[own], minlength=n + 1)
        own = own[many[r_class[own]] > 1]
        if len(own) < 2:
            continue
        pair = r_class[own] * (n + 1) + l_class[own]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice = np.zeros(len(own), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        hit = own[twice]
        lo[hit[hi[hit] < 0]] = d  # the distance grows: the first is the smallest
        hi[hit] = d
    return lo, hi


ANCHOR = "id long, digest long, first long, shape long, run long, context long"
STRETCH = "id long, digest long, start long, end long"
NO_ID = -(1 << 63)  # stands for a null id
WINDOWS = (1 << 20) - 1  # low bits of ``shape``


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("digest"),
                       t.cast("binary").alias("bytes"))


def _batch(columns: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in columns],
                                      names=[f.split()[0] for f in schema.split(", ")])


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """One row per anchor; ``shape`` packs its distance from the first window it owns and their number."""

    def run(batches):
        for b in batches:
            data, off = binary_views(b.column(2))
            ids, digests = b.column(0).to_numpy(), b.column(1).to_numpy()
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k in np.flatnonzero(np.diff(off) >= length):
                place, first, count, h, context = anchors(data[off[k]:off[k + 1]], length)
                for c, v in zip(cols, (np.full(len(place), ids[k]), np.full(len(place), digests[k]), first,
                                       (place - first) << 20 | count, h.view(np.int64), context.view(np.int64))):
                    c.append(v)
            yield _batch(cols, ANCHOR)

    return keyed.mapInArrow(run, ANCHOR)


def _sorted_stretches(suffixes: DataFrame, length: int) -> DataFrame:
    """Stretches found by sorting suffixes within ranges of their leading bytes."""
    dealt = suffixes.repartitionByRange("lead", "run").sortWithinPartitions("lead", "run").drop("lead")

    def some(t: pa.Table) -> pa.RecordBatch:
        data, off = binary_views(t["context"].combine_chunks())
        shape, first = t["shape"].to_numpy(), t["first"].to_numpy()
        before = shape >> 20
        lo, hi = repeated_windows(data, off[:-1], before, shape & WINDOWS, length)
        new = np.flatnonzero((hi >= 0) & (t["n"].to_numpy() == 1))
        anchor = (first + before)[new]
        return _batch([[t["id"].to_numpy()[new]], [t["digest"].to_numpy()[new]], [anchor - hi[new]],
                       [anchor - lo[new] + length]], STRETCH)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            runs = held["run"].to_numpy()
            ends = np.flatnonzero(runs[1:] != runs[:-1])
            at = 0
            for end in ends + 1:  # whole groups only; the last one may go on
                if end - at >= GROUP_ROWS or end == ends[-1] + 1 and len(held) >= GROUP_ROWS:
                    yield some(held.slice(at, end - at))
                    at = end
            held = held.slice(at)
        if held is not None and len(held):
            yield some(held)

    return dealt.mapInArrow(run, STRETCH)


def _hot_stretches(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for runs with very many contexts: windows compared by digests, whatever task they are in."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            data, off = binary_views(t["context"].combine_chunks())
            ids, digests, firsts, ns = (t[c].to_numpy() for c in ("id", "digest", "first", "n"))
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k in range(len(t)):
                b1 = data[off[k]:off[k + 1]]
                m = len(b1) - length + 1
                for c, base, inverse in ((0, BASE, INVERSE), (1, BASE2, INVERSE2)):
                    sums = _hashes(b1, base)
                    cols[c].append(mix64((sums[length:] - sums[:m]) * powers(inverse, m)).view(np.int64))
                for c, v in zip(cols[2:], (np.full(m, ids[k]), np.full(m, digests[k]), firsts[k] + np.arange(m),
                                           np.full(m, ns[k]))):
                    c.append(v)
            yield _batch(cols, "a long, b long, id long, digest long, start long, n long")

    windows = suffixes.select("id", "digest", "first", "n", "context").mapInArrow(
        run, "a long, b long, id long, digest long, start long, n long")
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    return windows.where("n = 1").join(twice, ["a", "b"]).select("id", "digest", "start", (F.col("start") + length).alias("end"))


def covered(keyed: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, digest, start, end): stretches whose every byte is in a repeated string; they may overlap."""
    rows = write_shared(_anchor_rows(keyed, length))
    # stored sides leave plain exchanges on both sides of the joins, so a hot run's partition can be split
    twice = write_shared(rows.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"))
    found = write_shared(rows.join(twice, "run"))
    context = ["run", "context", "shape"]
    # contexts: those that occur twice are covered as a whole; one of each goes on
    contexts = write_shared(found.groupBy(*context).agg(
        F.count("*").alias("n"), F.min(F.struct("id", "digest", "first")).alias("rep")))
    kinds = write_shared(contexts.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    owned = F.col("shape").bitwiseAND(F.lit(WINDOWS))
    whole = found.join(contexts.where("n > 1").select(*context), context).select(
        "id", "digest", F.col("first").alias("start"), (F.col("first") + owned + (length - 1)).alias("end"))

    # the suffixes that go on, with the bytes of their contexts
    go = write_shared(contexts.join(kinds, "run").select("rep.id", "rep.digest", "rep.first", "shape", "n", "run", "kinds"))
    per_text = go.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "shape", "n", "run", "kinds")).alias("at"))
    held = keyed.join(per_text, ["id", "digest"]).select("id", "digest", "bytes", F.explode("at").alias("x"))
    context_bytes = F.substring("bytes", (F.col("first") + 1).cast("int"), (owned + (length - 1)).cast("int"))
    suffixes = held.select("id", "digest", "x.*", "bytes").withColumn("context", context_bytes).withColumn(
        "lead", F.substring("context", (F.shiftright("shape", 20) + 1).cast("int"), F.lit(32))).drop("bytes")
    out = whole.unionByName(_sorted_stretches(suffixes.where(F.col("kinds") <= hot_rows), length))
    if go.where(F.col("kinds") > hot_rows).limit(1).count():
        out = out.unionByName(_hot_stretches(suffixes.where(F.col("kinds") > hot_rows), length))
    return out


WORD_ANCHOR = "id long, digest long, doc long, first long, shape long, run long, context long"


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of the words of one text: stretches without ASCII control characters and spaces."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], data > 32, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    sums = _hashes(data, BASE)
    return start, end, mix64((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start])


def _word_rows(keyed: DataFrame, words: int) -> DataFrame:
    """One row per anchor over words; ``first`` is a byte and ``shape`` packs the bytes of the context and its windows."""

    def run(batches):
        for b in batches:
            data, off = binary_views(b.column(3))
            ids, digests, docs = (b.column(c).to_numpy() for c in range(3))
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for k in np.flatnonzero(np.diff(off) >= 2 * words - 1):
                start, end, hashes = _words(data[off[k]:off[k + 1]])
                _, first, count, h, context = anchors(hashes, words)
                size = end[first + count + words - 2] - start[first]
                for c, v in zip(cols, (*(np.full(len(first), x[k]) for x in (ids, digests, docs)), start[first],
                                       size << 20 | count, h.view(np.int64), context.view(np.int64))):
                    c.append(v)
            yield _batch(cols, WORD_ANCHOR)

    return keyed.select("id", "digest", F.xxhash64("id", "digest").alias("doc"), "bytes").mapInArrow(run, WORD_ANCHOR)


def _word_windows(contexts: DataFrame, words: int) -> DataFrame:
    """One row per window of the contexts."""
    schema = "run long, window long, context long, count long, lo long, hi long"

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            data, off = binary_views(t["words"].combine_chunks())
            held = [t[c].to_numpy() for c in ("run", "context", "count", "lo", "hi")]
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k in range(len(t)):
                sums = _hashes(_words(data[off[k]:off[k + 1]])[2], BASE2)
                m = len(sums) - words
                cols[1].append(mix64((sums[words:] - sums[:m]) * powers(INVERSE2, m)).view(np.int64))
                for c, v in zip((cols[0], *cols[2:]), held):
                    c.append(np.full(m, v[k]))
            yield _batch(cols, schema)

    return contexts.select("run", "context", "count", "lo", "hi", "words").mapInArrow(run, schema)


def shared_runs(keyed: DataFrame, words: int = WORDS + 1) -> DataFrame:
    """(id, digest, n_shared): places of a text where a run of ``words`` words starts that another document holds too.

    Words are compared byte by byte, what separates them is not.  Rows that repeat (id, text) are one document.
    """
    rows = write_shared(_word_rows(keyed, words))
    documents = [F.min("doc").alias("lo"), F.max("doc").alias("hi")]
    found = write_shared(rows.join(write_shared(rows.groupBy("run").agg(*documents).where("lo < hi").select("run")), "run")
                         .withColumn("count", F.col("shape").bitwiseAND(F.lit(WINDOWS))))
    key = ["run", "context", "count"]
    # contexts of several documents are shared as a whole; the windows of the others are compared within their run
    contexts = write_shared(found.groupBy(*key).agg(*documents, F.min(F.struct("id", "digest", "first", "shape")).alias("rep")))
    open_runs = contexts.groupBy("run").agg(F.count("*").alias("kinds"), F.max(F.expr("lo = hi")).alias("alone"))
    go = write_shared(contexts.join(open_runs.where("kinds > 1 and alone").select("run"), "run").select(*key, "lo", "hi", "rep.*"))
    per_text = go.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "shape", *key, "lo", "hi")).alias("at"))
    once = keyed.join(per_text, ["id", "digest"]).dropDuplicates(["id", "digest"])  # rows may repeat
    held = once.select("bytes", F.explode("at").alias("x")).select("bytes", "x.*")
    windows = _word_windows(held.withColumn("words", F.substring(
        "bytes", (F.col("first") + 1).cast("int"), F.shiftright("shape", 20).cast("int"))), words)
    shared = windows.groupBy("run", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    partly = windows.where("lo = hi").join(shared.select("run", "window"), ["run", "window"]).groupBy(*key).agg(
        F.count("*").alias("n"))
    counted = contexts.where("lo < hi").select(*key, F.col("count").alias("n")).unionByName(partly)
    # one count per place, also if the row repeats
    places = found.join(counted, key).groupBy("id", "digest", "first").agg(F.max("n").alias("n"))
    return places.groupBy("id", "digest").agg(F.sum("n").alias("n_shared"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   hot_rows: int = HOT_ROWS, words: int = WORDS + 1) -> DataFrame:
    """One row per document: ``doc_id, bytes, spans`` (maximal removed stretches, 0-based bytes), ``kept`` and ``n_shared``
    (places where a run of ``words`` words starts that another document holds too)."""
    keyed = _keyed(docs, doc_id, text)
    stretches = covered(keyed, length, hot_rows).groupBy("id", "digest").agg(
        F.collect_list(F.struct("start", "end")).alias("stretches"))

    def make():
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def run(texts: pa.Array, found: pa.Array) -> list[pa.Array]:
            spans, kept = [], []
            for t, f in zip(texts, found):
                raw = t.as_py()
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in (f.as_py() or [])):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                spans.append([{"start": s, "end": e} for s, e in merged])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            return [pa.array(spans, span), pa.array(kept, pa.binary())]
        return run

    joined = keyed.join(stretches.join(shared_runs(keyed, words), ["id", "digest"], "full"), ["id", "digest"], "left")
    return append_columns(joined, ["bytes", "stretches"], RESULT, make).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "bytes", "spans", "kept",
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated strings of 400 bytes cover; after the digest, whether it held any, the
    remaining text (bytes that are no whole character any more show as U+FFFD) and the places where a run of over 50 words
    starts that another document holds too, removed or not."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.octet_length("bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      (removed > 0).alias("repeats"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
                      "n_shared")
