"""Severity of toxicity by cumulative-link ordinal regression on sparse words.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds, which stay ordered as
theta_k = theta_0 + sum of exp(steps).  x holds log(1 + count) of the words that separate toxic from other documents
(z score of the document frequencies).  The result is the expected grade, the probability of a grade above 0 and the most
probable grade.

The labels are 0/1, so grades 1 .. ``grades - 1`` of toxic training documents are cut at the quantiles of how
much of the separating words they hold; labels that already are grades (any values above 1) are taken as they are.

The fit sees a bounded sample: ``max_labelled`` labelled ids in the order of a keyed hash, near copies of a document
(same smallest three-word hash) counted once.  All documents are scored on their whole text, in one pass without a shuffle.

Defined results: null and empty texts hold no word and get the grade of the thresholds alone; labels that are null or
contradict each other for an id are left out; with no usable labels or one grade only, every document gets severity 0;
repeated rows are scored each; an empty table gives no row; all columns are carried through, those with a result's name are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, labelled_sample, mix64, rolling, sigmoid, table, tokens
from ranqa.session import write_shared

MAX_LABELLED, GRADES, MAX_WORDS, MIN_Z, MIN_DOCS = 8_000, 4, 2_000, 4.0, 4
#: a word must be in this share of the toxic or of the other documents, lest words of one family of copies count
MIN_SHARE = 0.03

SCORES = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
                       T.StructField("grade", T.LongType())])


@dataclass
class Model:
    words: np.ndarray    # sorted hashes
    weights: np.ndarray
    theta: np.ndarray    # increasing

    def score(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        low = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.words & low).view(np.int64)] = True
        z = np.zeros(len(docs))
        for k, d in enumerate(docs):
            d = d[maybe[(d & low).view(np.int64)]]
            at = np.minimum(np.searchsorted(self.words, d), len(self.words) - 1)
            at = at[self.words[at] == d] if len(at) else at
            if len(at):
                w, n = np.unique(at, return_counts=True)
                z[k] = np.log1p(n) @ self.weights[w]
        above = sigmoid(z[:, None] - self.theta[None, :])  # P(grade > k)
        exact = -np.diff(np.concatenate([np.ones((len(docs), 1)), above, np.zeros((len(docs), 1))], axis=1), axis=1)
        return [above.sum(axis=1), above[:, 0], exact.argmax(axis=1).astype(np.int64)]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_words: int, n_grades: int,
                l2: float = 1e-4, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model on sparse (row, col, value) triples."""
    n = len(y)
    share = np.array([(y <= k).mean() for k in range(n_grades - 1)]).clip(0.001, 0.999)
    theta0 = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(n_words), theta0[:1], np.log(np.maximum(np.diff(theta0), 0.05))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, first, gaps = par[:n_words], par[n_words], np.exp(par[n_words + 1:])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, values * w[cols], minlength=n)
        edge = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        up, down = edge[np.arange(n), y + 1], edge[np.arange(n), y]
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = slope[np.arange(n), y + 1] / p / n, slope[np.arange(n), y] / p / n
        g_z = d_up - d_down  # of the negative log likelihood
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, y + 1, -d_up)
        np.add.at(g_theta, y, d_down)
        g_theta = g_theta[1:-1]
        g = np.concatenate([np.bincount(cols, values * g_z[rows], minlength=n_words) + l2 * w, [g_theta.sum()],
                            [g_theta[k + 1:].sum() * gaps[k] for k in range(n_grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    gaps = np.exp(par[n_words + 1:])
    return par[:n_words], par[n_words] + np.concatenate([[0.0], np.cumsum(gaps)])


def choose_words(held: DataFrame, n_bad: int, n_good: int, max_words: int = MAX_WORDS) -> list[tuple[int, float]]:
    """(word, z score) of at most ``max_words`` separating words of ``held`` (one row per document and word, ``bad`` or not)."""
    per = held.groupBy("word").agg(F.sum(F.col("bad").cast("long")).alias("a"), F.sum((~F.col("bad")).cast("long")).alias("b"))
    pooled = (F.col("a") + F.col("b")) / F.lit(float(n_bad + n_good))
    share_a, share_b = F.col("a") / F.lit(float(n_bad)), F.col("b") / F.lit(float(n_good))
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / n_bad + 1 / n_good))
    scored = per.withColumn("z", (share_a - share_b) / spread).where(
        (F.abs("z") >= MIN_Z) & (F.greatest(share_a, share_b) >= MIN_SHARE) & (F.col("a") + F.col("b") >= min(MIN_DOCS, n_bad + n_good)))
    return [(r["word"], r["z"]) for r in scored.orderBy(F.abs("z").desc(), "word").limit(max_words).collect()]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_labelled: int = MAX_LABELLED, grades: int = GRADES) -> Model | None:
    """Model fitted on the bounded sample; None when the labels cannot be learned.

    Words are counted and chosen in Spark; the driver gets the chosen ones (``MAX_WORDS`` at most) and, per sampled document,
    its counts of these.
    """
    bare = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = labelled_sample(bare, labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias(label)), label,
                            max_labelled)
    pair = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.IntegerType())])
    rows = T.StructType([T.StructField("family", T.LongType()), T.StructField("words", T.ArrayType(pair))])

    def make():
        kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())]))

        def run(texts: pa.Array) -> list[pa.Array]:
            families, words = [], []
            for t in tokens(texts, bare=True):
                family = mix64(rolling(t, 3)) if len(t) >= 3 else t
                w, n = np.unique(t, return_counts=True)
                families.append(int(family.min().view(np.int64)) if len(family) else 0)
                words.append([{"word": a, "n": b} for a, b in zip(w.view(np.int64).tolist(), n.tolist())])
            return [pa.array(families, pa.int64()), pa.array(words, kind)]
        return run

    got = append_columns(known, ["text"], rows, make).select("family", F.col("__label").alias("label"), "doc_id", "words")
    # near copies once: of a family the row of the smallest id
    one = write_shared(got.groupBy("family", "label").agg(F.min_by("words", F.struct("doc_id", F.size("words"))).alias("words")))
    sampled = [(r["family"], r["label"]) for r in one.select("family", "label").orderBy("family", "label").collect()]  # MAX_LABELLED
    y = np.array([g for _, g in sampled], np.int64)
    if not len(y) or y.max() <= 0 or y.min() > 0:
        return None
    held = one.select("family", "label", F.explode("words").alias("x")).select("family", "label", "x.word", "x.n")
    chosen = choose_words(held.select("word", (F.col("label") > 0).alias("bad")), int((y > 0).sum()), int((y == 0).sum()))
    if not chosen:
        return None
    signed = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w, _ in chosen], "w long"))
    hits = held.join(signed, F.col("word") == F.col("w"), "left_semi").select("family", "label", "word", "n").toArrow()
    words = np.array([w for w, _ in chosen], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, z = words[order], np.array([v for _, v in chosen])[order]
    place = {k: i for i, k in enumerate(sampled)}
    at = np.array([place[k] for k in zip(hits["family"].to_pylist(), hits["label"].to_pylist())], np.int64)
    column = np.searchsorted(words, hits["word"].to_numpy().view(np.uint64))
    order = np.lexsort((column, at))
    return fit_words(words, z, at[order], column[order], hits["n"].to_numpy()[order].astype(float), y, grades)


def fit_words(words: np.ndarray, z: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, y: np.ndarray,
              grades: int = GRADES) -> Model:
    """Model from the counts (row, column, count) of the chosen words in the sampled documents."""
    bad = y > 0
    if y.max() == 1 and grades > 2:  # grade toxic documents by how much they hold
        much = np.bincount(rows, np.log1p(counts) * np.maximum(z, 0)[cols], minlength=len(y))
        cuts = np.quantile(much[bad], np.linspace(0, 1, grades)[1:-1])
        y = np.where(bad, 1 + np.searchsorted(cuts, much, "left"), 0)
    levels, y = np.unique(y, return_inverse=True)
    w, theta = fit_ordinal(rows, cols, np.log1p(counts), y, len(words), len(levels))
    return Model(words, w, theta)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``severity`` (expected grade), ``p_toxic`` (grade above 0) and ``grade`` (most probable)."""
    if model is None:
        zero = {"severity": F.lit(0.0), "p_toxic": F.lit(0.0), "grade": F.lit(0).cast("long")}
        return docs.drop(*SCORES.names).select("*", *[c.alias(n) for n, c in zero.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS numbers at most

    def make():
        return lambda texts: [pa.array(x) for x in shared.value.score(tokens(texts, bare=True))]

    return append_columns(docs, [text], SCORES, make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *SCORES.names, (F.col("p_toxic") >= 0.5).alias("toxic"))
