"""Catalog-wide fuzzy top-k: per probe the best entries by a scorer, found through an index instead of scoring every pair.

1. Entries that share a text become one with its ``k`` smallest ids (more cannot be among the best).
2. Texts and probes are dealt into blocks of bounded size; a task holds one pair of blocks and builds an inverted
   index of its texts: characters, character pairs and tokens with counts.  From what a probe shares with a text (count
   filter) and from both lengths (length filter) follows the most that the scorer can give.
3. First round: the texts of highest bound per probe are scored; the k-th best score found is the probe's threshold.
4. Second round: only texts whose bound reaches the threshold are scored.  A text left out cannot be among the best, so the
   result is that of scoring every pair.

Scores are Column functions and run where they belong (native, or Arrow batches); ``BOUNDS`` names the bound of each.  A
scorer without one is given every text.  Probes are a table of any size; ids identify them (repeated ids are
one probe, the smallest text).  Null texts on either side are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranqa.functions import blocks, fuzzy
from ranqa.functions.scoring import lev_ratio
from ranqa.session import write_shared

ENTRY_BLOCK, PROBE_BLOCK = 8_192, 256


@dataclass(frozen=True)
class Bound:
    """What a scorer compares: the ``form`` of a text, plain or in ``windows`` or ``weighted`` by tokens, by ``edits`` or blocks."""

    form: Callable[[Column], Column]
    edits: bool
    windows: bool = False
    weighted: bool = False


def _as_is(c: Column) -> Column:
    return c


BOUNDS: dict[Callable, Bound] = {
    lev_ratio: Bound(_as_is, True),
    fuzzy.window_ratio: Bound(_as_is, True, windows=True),
    fuzzy.weighted_ratio: Bound(fuzzy.clean, True, weighted=True),
    blocks.ratio: Bound(_as_is, False),
    blocks.partial_ratio: Bound(_as_is, False, windows=True),
    blocks.weighted_ratio: Bound(blocks.clean, False, weighted=True),
}


class _Postings:
    """(value, row, count) triples ordered by value."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        if len(values):
            kinds, place = np.unique(values, return_inverse=True)
            n = int(rows.max()) + 1
            key, count = np.unique(place * n + rows, return_counts=True)
            self.values, self.rows, self.counts = kinds[key // n], key % n, count
        else:
            self.values = self.rows = self.counts = np.zeros(0, np.int64)

    def shared(self, wanted: Counter, n: int) -> np.ndarray:
        """Common elements, with repeats, of each of ``n`` rows with ``wanted``."""
        out = np.zeros(n, np.int64)
        for v, c in wanted.items():
            lo, hi = np.searchsorted(self.values, [v, v + 1])
            out[self.rows[lo:hi]] += np.minimum(self.counts[lo:hi], c)
        return out


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _pairs(codes: np.ndarray) -> np.ndarray:
    return (codes[:-1] << 21) | codes[1:]


def _distinct_length(text: str) -> int:
    """Length of the text's distinct tokens with one space between."""
    return len(" ".join(set(text.split())))


def _rounded_up(score: np.ndarray) -> np.ndarray:
    """Rounded as scores are, halves up: parts of a weighted score are rounded before they are weighted."""
    return np.floor(score + 0.5 + 1e-9)


class TextIndex:
    """Inverted index of a block of texts for one kind of bound."""

    def __init__(self, forms: list[str], bound: Bound):
        self.n, self.bound = len(forms), bound
        self.length = np.array([len(t) for t in forms], np.int64)
        codes, rows = _code_points(forms)
        self.characters = _Postings(codes, rows)
        if bound.edits and not bound.windows and not bound.weighted:
            inside = rows[:-1] == rows[1:]
            self.pairs = _Postings(_pairs(codes)[inside], rows[:-1][inside])
        if bound.weighted:
            self.distinct = np.array([_distinct_length(t) for t in forms], np.int64)
            self.tokens: dict[str, list[int]] = {}
            for i, t in enumerate(forms):
                for w in set(t.split()):
                    self.tokens.setdefault(w, []).append(i)

    def most(self, form: str) -> np.ndarray:
        """The largest score, 0..100, that each text can have with a probe."""
        b, n = len(form), self.length
        codes = _code_points([form])[0]
        common = self.characters.shared(Counter(codes.tolist()), self.n).astype(float)
        longest, shortest = np.maximum(n, b).astype(float), np.minimum(n, b).astype(float)

        def plain(x: np.ndarray, y: float | np.ndarray) -> np.ndarray:
            size = np.maximum(x, y) if self.bound.edits else (x + y) / 2
            return _rounded_up(100 * np.minimum(common / np.maximum(size, 1), 1))

        def windows(x: np.ndarray, y: float | np.ndarray) -> np.ndarray:
            size = np.maximum(np.minimum(x, y), 1)
            inside = np.minimum(common, size)
            # a window at the end of the longer text may be cut short, down to what is matched
            return _rounded_up(100 * inside / size if self.bound.edits else 200 * inside / (size + inside))

        if self.bound.weighted:
            own = _distinct_length(form)
            shared = np.zeros(self.n, bool)
            for w in set(form.split()):
                shared[self.tokens.get(w, [])] = True
            apart = longest / np.maximum(shortest, 1)
            near = apart < fuzzy.SIMILAR_LENGTH
            scale = np.where(near, 1.0, np.where(apart > fuzzy.VERY_DIFFERENT_LENGTH, fuzzy.VERY_FAR, fuzzy.FAR))
            by_token = np.where(shared, 100.0, np.where(near, plain(self.distinct, own), windows(self.distinct, own)))
            out = np.maximum(plain(n, b), fuzzy.TOKEN_WEIGHT * scale * by_token)
            out = np.where(near, out, np.maximum(out, scale * windows(n, b)))
            out[shortest == 0] = 0
        elif self.bound.windows:
            out = np.where(shortest > 0, windows(n, b), 0.0)
        else:
            out = plain(n, b)
            if self.bound.edits:  # an edit changes two pairs of neighbours at most
                pairs = self.pairs.shared(Counter(_pairs(codes).tolist()), self.n)
                least = np.maximum(np.ceil((longest - 1 - pairs) / 2), 0)
                out = np.minimum(out, 100 * (longest - least) / np.maximum(longest, 1))
        out[longest == 0] = 0 if self.bound.weighted else 100
        return _rounded_up(out)


def _met(texts: DataFrame, probes: DataFrame, bound: Bound | None, k: int, entry_block: int, probe_block: int) -> DataFrame:
    """Pairs ``probe_id, probe_text, text, ids`` that may be among the best ``k``: those of highest bound when probes hold no
    threshold yet, else those that reach it."""
    n_texts, n_probes = -(-texts.count() // entry_block) or 1, -(-probes.count() // probe_block) or 1
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    left = texts.select(spread("text", n_texts).alias("tb"), all_of(n_probes).alias("pb"), none("long").alias("probe_id"), "text",
                        "form", "ids", none("double").alias("least"), none("long").alias("least_id"))
    right = probes.select(all_of(n_texts).alias("tb"), spread("probe_id", n_probes).alias("pb"), "probe_id",
                          F.col("probe_text").alias("text"), "form", none("array<long>").alias("ids"), "least", "least_id")

    def meet(t: pa.Table) -> pa.Table:
        is_text = t["ids"].is_valid().to_numpy()
        entries, asked = t.filter(pa.array(is_text)), t.filter(pa.array(~is_text))
        picked_p, picked_t = [], []
        if entries.num_rows and asked.num_rows:
            first = pc.list_element(entries["ids"], 0).to_numpy()
            index = TextIndex(entries["form"].to_pylist(), bound) if bound else None
            least = asked["least"].to_numpy(zero_copy_only=False).astype(float)
            least_id = asked["least_id"].to_numpy(zero_copy_only=False).astype(float)
            for i, form in enumerate(asked["form"].to_pylist()):
                if index is None:
                    some = np.arange(entries.num_rows)
                else:
                    most = index.most(form)
                    order = np.lexsort((first, -most))
                    if np.isnan(least[i]):
                        some = order[:2 * k]
                    else:
                        top = order[(most[order] > least[i]) | ((most[order] == least[i]) & (first[order] <= least_id[i]))]
                        zero = most[top] <= 0  # their score is 0: of these the smallest ids
                        some = np.concatenate([top[~zero], top[zero][:k]])
                picked_p.append(np.full(len(some), i))
                picked_t.append(some)
        join = lambda parts: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64))
        p, e = join(picked_p), join(picked_t)
        return pa.table({"probe_id": asked["probe_id"].take(p), "probe_text": asked["text"].take(p), "text": entries["text"].take(e),
                         "ids": entries["ids"].take(e)})

    return left.unionByName(right).groupBy("tb", "pb").applyInArrow(
        meet, "probe_id long, probe_text string, text string, ids array<long>")


def _best(met: DataFrame, scorer: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """Scored pairs by id, ranked, the best ``k`` per probe."""
    scored = met.withColumn("fuzzy", scorer(F.col("probe_text"), F.col("text")).cast("int")).select(
        "probe_id", "probe_text", F.explode("ids").alias("id"), "text", "fuzzy")
    order = Window.partitionBy("probe_id").orderBy(F.desc("fuzzy"), "id", "text")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_pairs(probes: DataFrame, catalog: DataFrame, *, k: int = 8, scorer: Callable[[Column, Column], Column] | None = None,
                    probe_id: str = "probe_id", probe_text: str = "probe_text", cand_id: str = "id", cand_text: str = "name",
                    entry_block: int = ENTRY_BLOCK, probe_block: int = PROBE_BLOCK) -> DataFrame:
    """The (probe, text) pairs that the second round scores: all that can be among the best ``k``."""
    scorer = scorer or lev_ratio
    bound = BOUNDS.get(scorer)
    form = bound.form if bound else _as_is
    names = catalog.select(F.col(cand_id).cast("long").alias("id"), F.col(cand_text).alias("text")).where("text is not null")
    smallest = names.withColumn("n", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("n") <= k)
    texts = write_shared(smallest.groupBy("text").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k at most
                         .select("text", "ids", form(F.col("text")).alias("form")))
    asked = probes.select(F.col(probe_id).cast("long").alias("probe_id"), F.col(probe_text).alias("probe_text")).where(
        "probe_text is not null").groupBy("probe_id").agg(F.min("probe_text").alias("probe_text"))
    asked = write_shared(asked.select("probe_id", "probe_text", form(F.col("probe_text")).alias("form"),
                                      F.lit(None).cast("double").alias("least"), F.lit(None).cast("long").alias("least_id")))
    if bound is not None:
        first = _best(_met(texts, asked, bound, k, entry_block, probe_block), scorer, k)
        least = write_shared(first.where(F.col("rank") == k).select(
            F.col("probe_id").alias("p"), F.col("fuzzy").cast("double").alias("least"), F.col("id").alias("least_id")))
        asked = asked.drop("least", "least_id").join(least, F.col("probe_id") == F.col("p"), "left").drop("p")
    return _met(texts, asked, bound, k, entry_block, probe_block)


def fuzzy_catalog_topk(probes: DataFrame, catalog: DataFrame, *, k: int = 8,
                       scorer: Callable[[Column, Column], Column] | None = None, probe_id: str = "probe_id",
                       probe_text: str = "probe_text", cand_id: str = "id", cand_text: str = "name",
                       entry_block: int = ENTRY_BLOCK, probe_block: int = PROBE_BLOCK) -> DataFrame:
    """Top-``k`` catalog entries per probe by a fuzzy scorer (ties: smaller id): ``probe_id, probe_text, rank, id, name, fuzzy``
    under the given column names."""
    met = candidate_pairs(probes, catalog, k=k, scorer=scorer, probe_id=probe_id, probe_text=probe_text, cand_id=cand_id,
                          cand_text=cand_text, entry_block=entry_block, probe_block=probe_block)
    best = _best(met, scorer or lev_ratio, k)
    return best.select(F.col("probe_id").alias(probe_id), F.col("probe_text").alias(probe_text), "rank", F.col("id").alias(cand_id),
                       F.col("text").alias(cand_text), "fuzzy")
