"""Dictionary segmentation of unspaced text: the most probable path through the lattice of known words.

``word_counts`` counts words over a whole corpus (a distributed count; the dictionary keeps the ``max_words`` most
frequent ones) and user words join with a count of their own.  A text is a row of nodes; every dictionary word that starts at
a node leads to the node behind it, and a single character always does (count 1).  The path of the largest summed
log probability wins, of equal ones the one whose first word is longer, and so on.

Words that the dictionary lacks come out as single characters.  With a model of word shapes (``word_shapes``, counted from
the same corpus) a run of single characters that holds one outside the dictionary is cut again by the
characters' most probable places in a word; white space stands alone.

The dictionary is broadcast (its size is bounded) and turned into a prefix table once per worker.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.operators.stopwords import tokens
from ranqa.operators.word_shapes import WordShapes, model_rows

MAX_WORDS = 100_000
#: entries of a prefix table that is looked up by place (of larger ones the keys are searched), and characters handled at once
DENSE, TOGETHER = 1 << 22, 1 << 18
#: sums this close are compared again in the order from the text's end; stretches longer than ``LONG`` always are
CLOSE, LONG = 1e-6, 512
#: dictionaries that a worker keeps
KEPT = 3


def word_counts(texts: DataFrame, text: str = "text", max_words: int = MAX_WORDS, min_count: int = 1,
                max_length: int = 32) -> DataFrame:
    """``word, n``: the most frequent words of spaced texts (ties by word), at most ``max_words`` of up to ``max_length`` characters."""
    words = texts.select(F.explode(tokens(F.col(text))).alias("word")).where(F.char_length("word") <= max_length)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counts.orderBy(F.desc("n"), "word").limit(max_words)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Lattice:
    """Words with their log probabilities, a prefix table, and a model of unknown words if there is one.

    Texts are cut many at a time, in numpy: all places take one more character per step, through a table of
    (prefix, character) -> longer prefix, until no word goes on there.  Places that no word crosses part the
    text into short pieces, and the best paths of all pieces are found side by side.  Sums are rounded, so where two ways are
    nearly equal inside a piece, it is settled anew with the sum of what follows it.
    """

    def __init__(self, counts: Iterable[tuple[str, int]], user_words: Iterable[str] = (), shapes: WordShapes | None = None):
        self.shapes = shapes
        known = {w: n for w, n in counts if w}
        most = max(known.values(), default=1)
        for w in user_words:  # a user's word is at least as likely as the most frequent one
            if w:
                known[w] = max(known.get(w, 0), most)
        total = math.log(max(sum(known.values()), 1))
        self.words = {w: math.log(n) - total for w, n in known.items()}
        self.single = -total  # a character that is no word
        self._tabulate()

    def _tabulate(self) -> None:
        """Per word length: the way from a prefix and a character to the longer prefix, and the weights of these."""
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        weights = np.fromiter(self.words.values(), float, len(self.words))
        flat = _points("".join(self.words))
        letters = np.unique(flat)
        self.code = np.zeros(max(int(letters[-1]) + 2, 2) if len(letters) else 2, np.int64)  # 0: in no word; the last is for higher ones
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.n_codes = len(letters) + 1
        flat = self.code[flat]
        first = np.cumsum(sizes) - sizes
        prefix, live, held = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), 1
        #: per length (dense table or None, sorted keys, weights; -inf is no word)
        self.levels: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]] = []
        for k in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > k]
            keys, prefix[live] = np.unique(prefix[live] * self.n_codes + flat[first[live] + k], return_inverse=True)
            weight = np.full(len(keys), -math.inf)
            ends = live[sizes[live] == k + 1]
            weight[prefix[ends]] = weights[ends]
            dense = None
            if held * self.n_codes <= DENSE:
                dense = np.full(held * self.n_codes, -1, np.int32)
                dense[keys] = np.arange(len(keys))
            self.levels.append((dense, keys, weight))
            held = len(keys)

    def _match(self, codes: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per word length (from 1 on) the places of ``at`` where a word begins and its weight; a single character always does."""
        out, prefix = [], np.zeros(len(at), np.int64)
        for k, (dense, keys, weight) in enumerate(self.levels or [(np.full(1, -1, np.int32), np.zeros(0, np.int64), np.zeros(0))]):
            key = prefix * self.n_codes + codes[at + k]
            if dense is not None:
                to = dense[key]
                go = to >= 0
            else:
                to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                go = keys[to] == key
            if k == 0:
                w = np.full(len(at), self.single)
                w[go] = np.where(weight[to[go]] > -math.inf, weight[to[go]], self.single)
                out.append((at, w))
            at, prefix = at[go], to[go].astype(np.int64)
            if not len(at):
                break
            if k:
                w = weight[prefix]
                word = np.flatnonzero(w > -math.inf)
                out.append((at[word], w[word]))
        return out

    def cut(self, text: str) -> list[str]:
        """The words of the most probable path; they join to the text."""
        return self.cut_all([text])[0]

    def cut_all(self, texts: list[str]) -> list[list[str]]:
        """``cut`` of every text; short ones are handled together."""
        out: list[list[str]] = []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) < TOGETHER:
                size += len(texts[to])
                to += 1
            out += self._cut_some(texts[at:to])
            at = to
        return out if self.shapes is None else [self._regrouped(pieces) for pieces in out]

    def _cut_some(self, texts: list[str]) -> list[list[str]]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        between = np.cumsum(sizes + 1) - 1  # one place behind every text
        points = _points("\0".join([*texts, ""]))
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        codes[between] = 0
        real = np.ones(len(codes), bool)
        real[between] = False
        found = self._match(np.append(codes, 0), np.flatnonzero(real))

        # pieces: stretches between places that no word crosses
        n_words = np.zeros(len(codes), np.int64)
        reach = np.arange(1, len(codes) + 1)
        ranks = []
        for k, (at, _) in enumerate(found):
            ranks.append(n_words[at])
            n_words[at] += 1
            reach[at] = at + k + 1
        edge = np.concatenate([[0], np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, len(codes) + 1)) + 1])
        width = np.diff(edge)
        end = np.repeat(edge[1:], width)

        # words in the order of the distance of their place to the piece's end, then of place and length
        place = np.flatnonzero(real)
        far = end[place] - place
        by = np.argsort(far.astype(np.int16) if len(far) and far.max() < 1 << 15 else far, kind="stable")
        place, far = place[by], far[by]
        first = np.zeros(len(codes) + 1, np.int64)
        total = np.cumsum(n_words[place])
        first[place] = total - n_words[place]
        to, weight = np.empty(int(n_words.sum()), np.int64), np.empty(int(n_words.sum()))
        for k, ((at, w), rank) in enumerate(zip(found, ranks)):
            slot = first[at] + rank
            to[slot], weight[slot] = at + k + 1, w
        inside = np.where(to == np.repeat(end[place], n_words[place]), len(codes), to)  # behind a piece the sum is 0

        best, step = np.zeros(len(codes) + 1), np.zeros(len(codes), np.int64)
        chosen, close = np.zeros(len(codes)), np.zeros(len(codes), bool)
        bounds = np.searchsorted(far, np.arange(1, min(int(far.max(initial=0)), LONG) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            p = place[a:b]
            starts, counts = first[p], n_words[p]
            low, high = starts[0], starts[-1] + counts[-1]
            value = weight[low:high] + best[inside[low:high]]
            top = np.maximum.reduceat(value, starts - low)
            near = value >= np.repeat(top - CLOSE, counts)
            best[p] = top
            close[p] = np.add.reduceat(near.view(np.int8), starts - low, dtype=np.int64) > 1
            at = np.flatnonzero(near & (value == np.repeat(top, counts)))
            where = np.repeat(p, counts)[at]
            step[where], chosen[where] = to[low:high][at], weight[low:high][at]  # of equal ones the last, the longest

        # the paths, and pieces to be settled with the sums as they are from the text's end: sums that may differ by rounding only
        begins, unsure = np.zeros(len(codes), bool), np.zeros(len(codes) + 1, bool)
        unsure[edge[:-1][width > LONG]] = True
        cur, head = (x[real[edge[:-1]] & (width <= LONG)] for x in (edge[:-1], edge[:-1]))
        while len(cur):
            begins[cur] = True
            unsure[head[close[cur]]] = True
            cur = step[cur]
            on = cur < end[head]
            cur, head = cur[on], head[on]
        text_end = between[np.searchsorted(between, np.flatnonzero(unsure))]
        known, value = -1, 0.0
        for s, e, last in zip(np.flatnonzero(unsure)[::-1].tolist(), end[unsure[:-1]][::-1].tolist(), text_end[::-1].tolist()):
            if not e <= known <= last:
                known, value = last, 0.0  # another text
            later = chosen[e:known][begins[e:known]][::-1]
            value = float(np.add.accumulate(np.append(value, later))[-1])
            self._settle(s, e, value, first, n_words, to, weight, begins, chosen)
            known = e

        out = []
        for text, last in zip(texts, between.tolist()):
            start = last - len(text)
            cuts = [*np.flatnonzero(begins[start:last]).tolist(), len(text)]
            out.append([text[i:j] for i, j in zip(cuts, cuts[1:])])
        return out

    @staticmethod
    def _settle(s: int, e: int, value: float, first: np.ndarray, n_words: np.ndarray, to: np.ndarray, weight: np.ndarray,
                begins: np.ndarray, chosen: np.ndarray) -> None:
        """The path through the piece ``s .. e`` when what follows it sums to ``value``."""
        best, step, taken = [-math.inf] * (e - s) + [value], [0] * (e - s), [0.0] * (e - s)
        for i in range(e - s - 1, -1, -1):
            a = int(first[s + i])
            b = a + int(n_words[s + i])
            for j, w in zip((to[a:b] - s).tolist(), weight[a:b].tolist()):
                if w + best[j] >= best[i]:  # of equal ones the longer first word
                    best[i], step[i], taken[i] = w + best[j], j, w
        begins[s:e] = False
        i = 0
        while i < e - s:
            begins[s + i], chosen[s + i] = True, taken[i]
            i = step[i]

    def _regrouped(self, pieces: list[str]) -> list[str]:
        """Runs of single characters with an unknown one among them, cut by word shapes."""
        out: list[str] = []
        run: list[str] = []
        for piece in [*pieces, ""]:
            if len(piece) == 1 and not piece.isspace():
                run.append(piece)
                continue
            out += run if all(c in self.words for c in run) else self.shapes.cut("".join(run))
            run = []
            if piece:
                out.append(piece)
        return out


_LATTICES: dict[str, Lattice] = {}


def segmenter(spark: SparkSession, counts: DataFrame, user_words: list[str] | None = None,
              max_words: int = MAX_WORDS, states: DataFrame | None = None) -> Callable[[Column], Column]:
    """Column function from a text to its array of words.  ``counts`` (``word, n``) holds ``max_words`` rows at most;
    ``states`` (``word_shapes.character_states``) adds the model of unknown words."""
    rows = [(r["word"], r["n"]) for r in counts.select("word", "n").limit(max_words + 1).collect()]
    if len(rows) > max_words:
        raise ValueError(f"the dictionary holds more than {max_words} words")
    shapes = None if states is None else model_rows(states)
    shared = spark.sparkContext.broadcast((rows, list(user_words or []), shapes))
    token = uuid.uuid4().hex

    def lattice() -> Lattice:
        if token not in _LATTICES:  # once per worker; of more than a few dictionaries the oldest is let go
            while len(_LATTICES) >= KEPT:
                _LATTICES.pop(next(iter(_LATTICES)))
            known, own, shapes = shared.value
            _LATTICES[token] = Lattice(known, own, None if shapes is None else WordShapes(shapes))
        return _LATTICES[token]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        words = iter(lattice().cut_all([t for t in texts if t is not None]))
        return pd.Series([None if t is None else next(words) for t in texts])

    return lambda c: cut(F.col(c) if isinstance(c, str) else c)
