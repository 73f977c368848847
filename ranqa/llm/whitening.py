"""Embedding whitening by spectrum slicing.

1. One pass gives the number of vectors and the exact integer sums; a second one the covariance: entries are centred at
   the rounded mean (integers, so the products add up exactly in any order while they stay below 2**53) and the rest of
   the mean is taken off.  Tasks send sums, never vectors.
2. The covariance (vector length squared numbers) is brought to tridiagonal form by reflections, which keeps the inertia of
   every shifted matrix.  The positive pivots of its LDL' at a shift count the eigenvalues above it; bisection on these
   counts gives slices that hold one leading eigenvalue each (or several that are equal to rounding).
3. Inside a slice Rayleigh quotient iteration on the covariance, kept orthogonal to the vectors found before, converges
   cubically.  A value outside its slice halves the slice and is sought again; in the end the counts on both sides of
   every value certify its number.
4. A last pass projects every row; one more over the result measures the covariance of what was whitened.

Vectors of another length form a fit list of their own: each length has its own sums, covariance and components, and
``n`` is its number of rows.

Defined results: vectors that are null, hold null or non-finite entries or entries of absolute value 2**25 and more
(their integers leave the exact range) are dropped; empty vectors have no component; components without variance
(eigenvalue up to 1e-12 of the trace) are left out, so equal vectors or a single one give no row; ``deviation`` is
null where it does not fit a long; repeated rows and null ids are rows like others; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.llm.common import SLICE_ROWS, shuffle_partitions, table
from ranqa.llm.vectors import floors, lengths, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
ENTRY_BELOW = float(1 << 25)
#: share of the trace up to which an eigenvalue counts as none
NO_VARIANCE = 1e-12
#: width, as a share of the largest eigenvalue, at which a slice with several eigenvalues is not cut further
TIE = 1e-11

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


# ------------------------------------------------------------------ spectrum ---

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, next diagonal) of a tridiagonal matrix with the eigenvalues of the symmetric ``v``."""
    a = v.copy()
    d = len(a)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        off[k] = -size if x[0] > 0 else size
        u = x.copy()
        u[0] -= off[k]
        u /= np.linalg.norm(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * (np.outer(u, w) + np.outer(w, u))
    if d > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off


def counts_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: positive pivots of LDL' of the shifted matrix."""
    tiny = 1e-300 + np.finfo(float).eps ** 2 * (np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0))
    above = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    before = 0.0
    for a, b in zip(diagonal, np.append(off, 0.0)):
        pivot = a - shifts - before * before / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
        before = b
    return above


@dataclass
class Slice:
    low: float
    high: float
    first: int   # number of the largest eigenvalue in (low, high], from 0
    count: int


def slices(count: Callable[[np.ndarray], np.ndarray], low: float, high: float, wanted: int, width: float) -> list[Slice]:
    """Slices of (low, high] with one eigenvalue each (several only below ``width``) until ``wanted`` are held, from above."""
    todo = [Slice(low, high, 0, int(count(np.array([low]))[0]))]
    done: list[Slice] = []
    while todo:
        single = [s for s in todo if s.count == 1 or s.high - s.low <= width]
        done += single
        cut = [s for s in todo if not (s.count == 1 or s.high - s.low <= width)]
        middle = np.array([(s.low + s.high) / 2 for s in cut])
        upper = count(middle) if cut else middle
        todo = []
        for s, m, c in zip(cut, middle, upper):
            n = int(c) - s.first  # above the middle
            todo += [Slice(m, s.high, s.first, n), Slice(s.low, m, s.first + n, s.count - n)]
        todo = [s for s in todo if s.count > 0 and s.first < wanted]
    return sorted(done, key=lambda s: s.first)


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    for nudge in (0.0, 1e-15, -3e-15, 1e-14):
        try:
            y = np.linalg.solve(v - (shift + nudge) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return x


def rayleigh(v: np.ndarray, shift: float, x: np.ndarray, known: np.ndarray) -> tuple[float, np.ndarray]:
    """(eigenvalue, vector) that Rayleigh quotient iteration from ``shift`` and ``x`` reaches, orthogonal to ``known``'s rows."""
    def clean(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - known.T @ (known @ y)
            y = y / np.linalg.norm(y)
        return y

    x = clean(x)
    for _ in range(2):  # inverse iteration: towards the eigenvalue next to the slice's middle
        x = clean(_solve(v, shift, x))
    value, best = float(x @ v @ x), np.inf
    for _ in range(12):
        off = float(np.linalg.norm(v @ x - value * x))
        if off >= best or off < 1e-17:
            break
        best, kept = off, (value, x)
        x = clean(_solve(v, value, x))
        value = float(x @ v @ x)
    return kept if off >= best else (value, x)


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of the covariance ``v``: at most ``wanted``, those with variance."""
    d, trace = len(v), float(np.trace(v)) if len(v) else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    a = v / trace
    diagonal, off = tridiagonal(a)
    count = lambda s: counts_above(diagonal, off, s)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    high = float((diagonal + reach).max()) * (1 + 1e-12)
    wanted = min(wanted, int(count(np.array([NO_VARIANCE]))[0]))
    rnd = np.random.default_rng(17)
    values: list[float] = []
    known = np.zeros((0, d))
    for s in slices(count, NO_VARIANCE, high, wanted, TIE * high) if wanted else []:
        slack = 1e-14 * high
        for _ in range(s.count):
            low, up = s.low, s.high
            for _ in range(80):
                value, x = rayleigh(a, (low + up) / 2, rnd.normal(size=d), known)
                if low - slack <= value <= up + slack:
                    break
                middle = (low + up) / 2  # the wanted value is where the counts say
                if s.first < count(np.array([middle]))[0]:
                    low = middle
                else:
                    up = middle
            values.append(value)
            known = np.concatenate([known, x[None]])
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    values, known = np.array(values)[order], known[order]
    slack = 1e-10 * high
    number = np.arange(len(values))
    if (count(values - slack) <= number).any() or (count(values + slack) > number).any():
        raise ArithmeticError("eigenvalue counts do not certify the numbering")
    return values * trace, known


# ---------------------------------------------------------------------- Spark ---

def _numbered(rows: np.ndarray) -> pa.RecordBatch:
    """The rows of a matrix as (i, v)."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()),
                                       pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "v"])


def _sum_rows(partials: DataFrame) -> DataFrame:
    """Element sums by ``i`` of the arrays ``v`` that tasks sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy()
                total[i] = total[i] + v if i in total else v
        for i, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["i", "v"])

    return partials.repartition(shuffle_partitions(partials.sparkSession), "i").mapInArrow(run, "i int, v array<double>")


def integer_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sum of floor(64 * entry) by dimension) of vectors of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                s = floors(b.column(0), SCALE).sum(axis=0)
                n, total = n + b.num_rows, s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total.tolist()]], pa.list_(pa.int64()))], names=["s"])

    each = rows.select("e").mapInArrow(run, "s array<long>").select(F.posexplode("s").alias("i", "s"))
    total = each.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    found = [int(r["s"]) for r in sorted(total, key=lambda r: r["i"])]
    return found[0], found[1:]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of the integer vectors, centred before multiplying."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(s - int(c) * n) / n for s, c in zip(sums, centre)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(centre), len(centre))), 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                z = (floors(b.column(0).slice(at, SLICE_ROWS), SCALE) - centre).astype(float)
                total += z.T @ z
                seen += len(z)
        if seen:
            yield _numbered(total)

    found = _sum_rows(rows.select("e").mapInArrow(run, "i int, v array<double>")).collect()  # one row per dimension
    v = np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]) / n - np.outer(rest, rest)
    return (v + v.T) / 2


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)**2; null beyond a long."""
    largest = float(n) * float(np.abs(x).max(initial=0)) + float(max((abs(s) for s in sums), default=0))
    if largest * largest * max(len(sums), 1) < 2.0 ** 62:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


@dataclass
class Whitening:
    """What a fit leaves: enough to whiten any vector of its length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors (floor(64 * entry), without the offset, which cancels)."""
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([float(s - int(c) * self.n) / self.n for s, c in zip(self.sums, centre)])
        return ((x - centre) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the vectors ``e`` of one length."""
    n, sums = integer_sums(rows)
    v = covariance(rows, n, sums)
    values, vectors = leading_components(v, components)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k + 1, k)), 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                w = model.project(floors(b.column(0).slice(at, SLICE_ROWS), SCALE))
                total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
                seen += len(w)
        if seen:
            yield _numbered(total)

    found = _sum_rows(rows.select("e").mapInArrow(run, "i int, v array<double>")).collect()  # components + 1 rows
    total = np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]) / model.n
    cov = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding, ENTRY_BELOW)
    out = None
    for d in lengths(rows):
        some = rows.where(F.col("d") == d)
        model = fit(some, components) if d else None
        if model is None or not len(model.values):
            continue
        part = some.select("vec_id", "e").mapInArrow(_projector(model, identity_error(some, model)), RESULT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def _projector(model: Whitening, error: float) -> Callable:
    k = len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                x, m = floors(part.column(1), SCALE), part.num_rows
                dev = pa.array(deviations(x, model.n, model.sums), pa.int64())
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, model.n)), dev.take(row), pa.array(model.project(x).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading components of the table's covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))
