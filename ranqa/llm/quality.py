"""Quality classifier by co-training a text-content view and a page-metadata view.

Content view: byte pairs of the whole text hashed into ``BINS`` counts, as square roots of shares, and the shares of
repeated words, capitals and signs in steps.
Metadata view: language and source in hashed bins, length and line figures in logarithmic bins.
Each view is a logistic regression.  In every round each view labels the documents of an unlabelled pool that it is
most confident about, and the other view learns them too.  Both views are then calibrated on labelled rows that
neither learned from (Platt scaling), combined by a logistic regression over the two calibrated logits, and all
documents are scored in one pass without a shuffle.

The fit sees a bounded sample: ``max_labelled`` labelled and ``max_pool`` unlabelled documents, chosen by a keyed hash.
Everything else covers all documents.

Defined results: null text counts as empty and null language or source as a value of its own; empty texts get the
score of the fitted views like any other; with no usable labels, or labels of one class only, every document
scores 1 and stays; repeated rows are scored each; an empty table gives no row; all columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, binary_views, labelled_sample, sigmoid, table, tokens

BINS, CATEGORY_BINS, NUMBER_BINS = 512, 32, 16
MAX_LABELLED, MAX_POOL, ROUNDS = 6_000, 6_000, 4
#: a document goes below this score; under one half, as a lost clean document costs more than a kept poor one
THRESHOLD = 0.25
#: bytes that a text needs for its byte pairs to count half
SMALL_TEXT = 100

_STEPS = np.array([0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3])
_CAPITAL = np.array([65 <= i <= 90 for i in range(256)])
_SIGN = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".," for i in range(256)])

SCORES = T.StructType([T.StructField("p_content", T.DoubleType()), T.StructField("p_metadata", T.DoubleType()),
                       T.StructField("p_quality", T.DoubleType())])


def content_view(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, then indicators of text figures."""
    data, off = binary_views(pc.fill_null(texts, ""))
    out = np.zeros((len(off) - 1, BINS), np.float32)
    kinds = [np.zeros(len(out)) for _ in (_CAPITAL, _SIGN)]
    first = 0
    while first < len(out):  # in groups of about a megabyte
        last = max(first + 1, int(np.searchsorted(off, off[first] + (1 << 20), "right")) - 1)
        b = data[off[first]:off[last]].astype(np.int64)
        rel = off[first:last + 1] - off[first]
        doc = np.repeat(np.arange(last - first), np.diff(rel))
        pair = ((b[:-1] * 256 + b[1:]) * 40503 >> 7) % BINS + doc[:-1] * BINS
        pair = pair[doc[:-1] == doc[1:]]  # not across documents
        for count, kind in zip(kinds, (_CAPITAL, _SIGN)):
            count[first:last] = np.bincount(doc[kind[b]], minlength=last - first)
        out[first:last] = np.bincount(pair, minlength=(last - first) * BINS).reshape(-1, BINS)
        first = last
    out /= out.sum(axis=1, keepdims=True) + SMALL_TEXT  # a few bytes say little: their shares shrink
    np.sqrt(out, out=out)
    again = np.array([(w[1:] == w[:-1]).sum() / (len(w) + 5) for w in tokens(texts)])
    return np.concatenate([out, _steps([again, *(c / (np.diff(off) + 20.0) for c in kinds)])], axis=1)


def _steps(figures: list[np.ndarray]) -> np.ndarray:
    """Indicators of the step that each figure is in."""
    n = len(figures[0])
    block = np.zeros((n, len(figures), len(_STEPS) + 1), np.float32)
    for k, f in enumerate(figures):
        block[np.arange(n), k, np.searchsorted(_STEPS, f)] = 1
    return block.reshape(n, -1)


def metadata_view(categories: list[pa.Array], texts: pa.Array) -> np.ndarray:
    """(n, bins) indicators of hashed categories and of logarithmic length figures."""
    n = len(texts)
    parts = []

    def indicator(bins: np.ndarray, size: int) -> None:
        block = np.zeros((n, size), np.float32)
        block[np.arange(n), bins] = 1
        parts.append(block)

    for k, values in enumerate(categories):
        known = {v: xxhash.xxh32_intdigest(f"{k}={v}") % CATEGORY_BINS for v in set(values.to_pylist())}
        indicator(np.array([known[v] for v in values.to_pylist()], np.int64), CATEGORY_BINS)
    texts = pc.fill_null(texts, "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    for figure in (chars, lines, chars / lines):
        indicator(np.clip(np.log2(figure + 1), 0, NUMBER_BINS - 1).astype(np.int64), NUMBER_BINS)
    return np.concatenate(parts, axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 3e-4, steps: int = 200) -> np.ndarray:
    """Weights with the intercept last: Newton steps for few features, accelerated gradient for many."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float32)
    reg = np.full(x.shape[1], l2, np.float32)
    reg[-1] = 1e-6
    w = np.zeros(x.shape[1], np.float32)
    if x.shape[1] <= 8:
        for _ in range(30):
            p = sigmoid(x @ w)
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + np.diag(reg)
            w = w - np.linalg.solve(h, x.T @ (p - y) / len(x) + reg * w).astype(np.float32)
        return w
    step = 1.0 / (0.25 * float((x * x).sum(axis=1).mean()) + l2)
    z, last = w.copy(), w.copy()
    for k in range(steps):
        w = z - step * (x.T @ (sigmoid(x @ z) - y).astype(np.float32) / len(x) + reg * z)
        z = w + k / (k + 3) * (w - last)
        last = w
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1] + w[-1]).astype(float)


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    platt: np.ndarray  # (2, 2): slope and intercept by view
    mix: np.ndarray    # two weights and the intercept

    def score(self, content: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        z = [a * logit(x, w) + b for x, w, (a, b) in
             zip((content, metadata), (self.content, self.metadata), self.platt)]
        return [sigmoid(z[0]), sigmoid(z[1]), sigmoid(logit(np.stack(z, axis=1), self.mix))]


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS,
             share: float = 0.05, confident: float = 0.95) -> Model:
    """Fit both views; row i of both views is one document.  Every fourth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if min(y[held].min(initial=1), y[~held].min(initial=1)) == 1 or max(y[held].max(initial=0), 0) == 0 or y[~held].max() == 0:
        held = np.zeros(len(y), bool)  # too few rows to set some aside
    cal = held if held.any() else ~held
    learn = [[v[~held], y[~held]] for v in views]
    fitted = [fit_logistic(x, t) for x, t in learn]
    free = [np.ones(len(pools[0]), bool) for _ in views]  # by the view that would learn them
    for _ in range(rounds):
        for teacher in (0, 1):
            pupil = 1 - teacher
            p = sigmoid(logit(pools[teacher], fitted[teacher]))
            for label, sure in ((1, p), (0, 1 - p)):
                some = np.flatnonzero(free[pupil] & (sure >= confident))
                # in the classes' own proportion, most confident first
                most = int(share * len(p) * np.mean(y[~held] == label)) + 1
                some = some[np.argsort(-sure[some], kind="stable")[:most]]
                free[pupil][some] = False
                learn[pupil] = [np.concatenate([learn[pupil][0], pools[pupil][some]]),
                                np.concatenate([learn[pupil][1], np.full(len(some), label)])]
        fitted = [fit_logistic(x, t) for x, t in learn]
    raw = [logit(v[cal], w) for v, w in zip(views, fitted)]
    platt = np.stack([fit_logistic(z[:, None], y[cal]) for z in raw])
    both = np.stack([a * z + b for z, (a, b) in zip(raw, platt)], axis=1)
    return Model(*fitted, platt, fit_logistic(both, y[cal], l2=1e-2))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        categories: tuple[str, ...] = ("lang", "source"), max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL,
        rounds: int = ROUNDS) -> Model | None:
    """Model fitted on bounded samples; None when the labels cannot be learned."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)])
    marked = labels.withColumnRenamed(doc_id, "doc_id")
    known = labelled_sample(bare, marked, label, max_labelled)
    n = bare.count()
    # the pool: a keyed-hash share of all rows, other keys than the labelled sample's
    slice_ = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(23)), F.lit(1 << 30))
    pool = bare.where(slice_ < F.lit(int(min(1.0, max_pool / max(n, 1)) * (1 << 30)))).withColumn(
        "__label", F.lit(-1)).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_anti")
    rows = known.unionByName(pool).withColumn("__order", F.xxhash64("doc_id", "text"))
    features = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    inputs = ["text", *[f"c{i}" for i in range(len(categories))]]

    def make():
        def views(texts: pa.Array, *cats: pa.Array) -> list[pa.Array]:
            a, b = content_view(texts).astype(np.float16), metadata_view(list(cats), texts).astype(np.uint8)
            return [pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())]
        return views

    got = append_columns(rows, inputs, features, make).select("__label", "__order", "a", "b").toArrow()
    got = got.sort_by([("__label", "ascending"), ("__order", "ascending")])
    y = got["__label"].to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return None
    x = [np.frombuffer(b"".join(got[c].to_pylist()), t).reshape(len(y), -1).astype(np.float32)
         for c, t in (("a", np.float16), ("b", np.uint8))]
    seen = np.isin(y, (0, 1))
    order = np.argsort(got["__order"].to_numpy()[seen], kind="stable")  # both classes mixed
    return co_train([v[seen][order] for v in x], y[seen][order].astype(float), [v[y == -1] for v in x], rounds)


def score(docs: DataFrame, model: Model | None, text: str = "text",
          categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` plus ``p_content``, ``p_metadata`` and the combined ``p_quality``."""
    if model is None:
        return docs.drop(*SCORES.names).select("*", *[F.lit(1.0).alias(c) for c in SCORES.names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def make():
        def run(texts: pa.Array, *cats: pa.Array) -> list[pa.Array]:
            return [pa.array(np.asarray(p, float), pa.float64())
                    for p in shared.value.score(content_view(texts), metadata_view([c.cast(pa.string()) for c in cats], texts))]
        return run

    return append_columns(docs, [text, *categories], SCORES, make)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the calibrated scores of both views, their combination and the decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *SCORES.names, (F.col("p_quality") >= THRESHOLD).alias("keep"))
