"""Unknown words in unspaced text: characters tagged by their place in a word.

``character_states`` counts, over the words of a whole corpus, how often a character begins a word, is inside, ends it or is
one by itself, and which place follows which.  Distinct words are counted first, so characters are counted once per
distinct word and not once per occurrence.  ``WordShapes`` cuts a run of characters that no dictionary explains
into the words of the most probable sequence of places; of equal ones the one whose first word is longer, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranqa.operators.stopwords import tokens

#: (place, character) counts and moves that a model may hold
MAX_STATES = 50_000
BEGIN, INSIDE, END, SINGLE = "B", "M", "E", "S"
#: places that may follow each one; on equal probability the first is taken
FOLLOWS = {BEGIN: (INSIDE, END), INSIDE: (INSIDE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}


def _first_place(word: Column) -> Column:
    return F.when(F.char_length(word) > 1, BEGIN).when(F.char_length(word) == 1, SINGLE)


def character_states(texts: DataFrame, text: str = "text", max_length: int = 32) -> DataFrame:
    """``state, next, character, n`` over the words (of up to ``max_length`` characters) of spaced texts: rows with a
    character say how often it has the place ``state``, rows with a ``next`` how often that place follows."""
    words = texts.select(tokens(F.col(text)).alias("ws"))
    # every word beside the next one, null beside the last
    pairs = words.select(F.explode(F.arrays_zip("ws", F.slice("ws", 2, F.size("ws")).alias("later"))).alias("x")).select(
        F.col("x.ws").alias("word"), _first_place(F.col("x.later")).alias("after"))
    distinct = (pairs.where(F.char_length("word") <= max_length)
                .groupBy("word", "after").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("size", F.char_length("word")))

    def place(k: Column) -> Column:
        return (F.when(F.col("size") == 1, SINGLE).when(k == 1, BEGIN).when(k == F.col("size"), END).otherwise(INSIDE))

    k = F.col("k")
    at = distinct.select("word", "after", "n", "size", F.explode(F.sequence(F.lit(1), "size")).alias("k"))
    # one row per character, its place and the next place; both kinds of counts are sums over these few
    joint = at.groupBy(place(k).alias("state"), F.when(k < F.col("size"), place(k + 1)).otherwise(F.col("after")).alias("next"),
                       F.substring("word", k, F.lit(1)).alias("character")).agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    both = joint.select("state", "n", F.explode(F.array(
        F.struct(none.alias("next"), F.col("character")),
        F.struct(F.col("next"), none.alias("character")))).alias("x")).select("state", "x.*", "n")
    counts = both.groupBy("state", "next", "character").agg(F.sum("n").alias("n"))
    return counts.where(F.col("next").isNotNull() | F.col("character").isNotNull())


class WordShapes:
    """Log probabilities of places, moves and characters, one added to every count."""

    def __init__(self, states: Iterable[tuple[str, str | None, str | None, int]]):
        shown: dict[str, dict[str, int]] = {s: {} for s in FOLLOWS}
        moved: dict[str, dict[str, int]] = {s: {} for s in FOLLOWS}
        for state, nxt, character, n in states:
            if character is not None:
                shown[state][character] = n
            else:
                moved[state][nxt] = n
        kinds = len({c for some in shown.values() for c in some}) + 1
        size = {s: sum(some.values()) + kinds for s, some in shown.items()}
        self.shown = {s: {c: math.log((n + 1) / size[s]) for c, n in some.items()} for s, some in shown.items()}
        self.unseen = {s: -math.log(size[s]) for s in FOLLOWS}
        self.moved = {s: {t: math.log((moved[s].get(t, 0) + 1) / (sum(moved[s].values()) + 2)) for t in to}
                      for s, to in FOLLOWS.items()}
        first = {s: sum(shown[s].values()) + 1 for s in (BEGIN, SINGLE)}
        self.first = {s: math.log(n / sum(first.values())) for s, n in first.items()}

    def cut(self, run: str) -> list[str]:
        """The words of the most probable places; they join to the run."""
        if not run:
            return []
        value: dict[str, float] = {BEGIN: -math.inf, INSIDE: -math.inf, END: 0.0, SINGLE: 0.0}  # a word ends with the run
        value = {s: v + self.shown[s].get(run[-1], self.unseen[s]) for s, v in value.items()}
        step: list[dict[str, str]] = []
        for c in reversed(run[:-1]):
            to = {s: max(FOLLOWS[s], key=lambda t: self.moved[s][t] + value[t]) for s in FOLLOWS}
            value = {s: self.shown[s].get(c, self.unseen[s]) + self.moved[s][t] + value[t] for s, t in to.items()}
            step.append(to)
        state = max((BEGIN, SINGLE), key=lambda s: self.first[s] + value[s])
        out, start = [], 0
        for i in range(len(run)):
            if state in (END, SINGLE):
                out.append(run[start:i + 1])
                start = i + 1
            if i < len(run) - 1:
                state = step[len(run) - 2 - i][state]
        return out


def model_rows(states: DataFrame, max_states: int = MAX_STATES) -> list[tuple[str, str | None, str | None, int]]:
    """The moves (8 at most) and the most frequent (place, character) counts, ``max_states`` rows in all."""
    kept = states.orderBy(F.col("next").isNull(), F.desc("n"), "state", "character").limit(max_states)
    return [(r["state"], r["next"], r["character"], r["n"]) for r in kept.collect()]
