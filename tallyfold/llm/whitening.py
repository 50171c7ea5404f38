"""Embedding whitening by incremental eigendecomposition.

Entries become integers x = floor(64 c) + 1000000. Every task reads its
vectors once and keeps their count, their exact sums and the spectrum of
their centred scatter: a vector at distance d from the running mean of n
vectors adds n / (n + 1) times the outer product of d, which is one rank-one
update of the spectrum. An update solves the secular equation for all roots
at once (each from its nearer pole, so that differences to poles keep full
precision), after deflation of components that the update does not touch
and rotation of equal eigenvalues onto one direction; the eigenvectors come
from the vector for which the computed roots are exact, so they stay
orthogonal. The tasks' spectra are combined in groups of at most `fan_in`:
the eigenpairs of one are rank-one updates of the other, and so is the
distance of the means. One more pass then does a Rayleigh-Ritz step: the
vectors, centred and rotated into the combined basis, give a small matrix
that is diagonal but for rounding; its eigenvectors finish the basis.

The basis is complete (as many vectors as dimensions), so the refined pairs
are those of the covariance to double precision, not approximations.

Scale: five passes over the vectors (their length, spectra, refinement,
check, result); a task holds a batch and some d x d matrices, and gives one
row of d x d numbers that is combined by a tree of groups of `fan_in` rows,
each level a stored table. The driver gets the last row. No pass shuffles vectors, so
repeated vectors and uneven keys do not matter.

Recovery: each level of a tree is a stored table; a task's row depends on
its own rows alone.

Defined cases: rows whose vector is null, or holds null or non-finite
entries, are dropped; so are empty vectors and those of another length than
most (the longer among equally frequent lengths). Repeated rows and rows
with repeated or null ids count as rows of their own. Components whose
eigenvalue is zero to working precision cannot be whitened and have no rows
(one vector, or equal vectors only: no rows at all). An empty table gives
an empty result. Entries beyond 2^40 and deviations beyond 64 bits raise an
error. Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import stored

EPS = np.finfo(float).eps
SHIFT = 1_000_000
PARTIAL = "part bigint, state binary"
PARTIALS = pa.schema([("part", pa.int64()), ("state", pa.binary())])
WHITENED = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                      ("whitened", pa.float64()), ("explained", pa.float64())])


def rotate_equal(values: np.ndarray, z: np.ndarray, vectors: np.ndarray, tol: float) -> None:
    """Neighbouring eigenvalues equal to working precision: a rotation of
    their vectors gives the update's weight to the later one. In place."""
    at = np.flatnonzero(z)
    if not len(at):
        return
    gap, a, b = np.diff(values[at]), np.abs(z[at[:-1]]), np.abs(z[at[1:]])
    if not np.any(gap * a * b <= tol * (a * a + b * b)):
        return
    last = at[0]
    for i in at[1:]:
        r = np.hypot(z[last], z[i])
        c, s = z[i] / r, z[last] / r
        gap = values[i] - values[last]
        if abs(gap * c * s) <= tol:
            z[last], z[i] = 0.0, r
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            values[last], values[i] = values[last] + gap * s * s, values[i] - gap * s * s
        last = i


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - x)) for ascending distinct
    poles and positive weights: (roots, poles minus roots with a row for
    each root). Each root is found as its distance from the nearer pole, by
    rational interpolation inside a bracket."""
    n = len(poles)
    row = np.arange(n)
    gap = np.append(np.diff(poles), weights.sum() * (1 + 4 * EPS))
    middle = poles + gap / 2
    f = 1 + np.sum(weights / (poles - middle[:, None]), axis=1)
    right = (f < 0) & (row < n - 1)  # the nearer pole is the next one
    origin = np.where(right, np.append(poles[1:], 0), poles)
    apart = poles - origin[:, None]
    low = np.where(right, -gap / 2, np.where(f < 0, gap / 2, 0))
    high = np.where(right, 0, np.where(f < 0, gap, gap / 2))
    x = (low + high) / 2
    left = np.tri(n)
    active = np.ones(n, bool)
    for _ in range(100):
        i, at = row[active], x[active]
        inverse = 1 / (apart[active] - at[:, None])
        square, mask = inverse * inverse, left[active]
        total, below = inverse @ weights, (inverse * mask) @ weights
        value, size = 1 + total, 1 + np.abs(total - below) + np.abs(below)
        left_slope = (square * mask) @ weights
        right_slope = square @ weights - left_slope
        own = apart[i, i] - at
        nxt = np.where(i < n - 1, apart[i, np.minimum(i + 1, n - 1)] - at, np.inf)
        low[active] = np.where(value < 0, at, low[active])
        high[active] = np.where(value > 0, at, high[active])
        with np.errstate(all="ignore"):
            # two poles around the root; for the last root one pole and a constant
            c = value - own * left_slope - nxt * right_slope
            a = (own + nxt) * value - own * nxt * (left_slope + right_slope)
            b = own * nxt * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(i == n - 1, own + left_slope * own * own / (value - left_slope * own), step)
        done = (np.abs(value) <= 4 * EPS * size) | (np.abs(step) <= EPS * np.abs(at))
        new = at + step
        inside = (new > low[active]) & (new < high[active])
        new = np.where(inside, new, (low[active] + high[active]) / 2)
        done |= new == at
        x[active] = np.where(done, at, new)
        active[active] = ~done
        if not active.any():
            break
    return origin + x, apart - x[:, None]


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of a symmetric
    non-negative matrix under rank-one updates."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray):
        self.values, self.vectors = values, vectors

    @classmethod
    def zero(cls, d: int) -> Spectrum:
        return cls(np.zeros(d), np.eye(d))

    def add(self, v: np.ndarray, weight: float = 1.0) -> None:
        """The matrix plus `weight` (positive) times the outer product of v."""
        z = v @ self.vectors
        norm = float(np.sqrt(z @ z))
        rho = weight * norm * norm
        if not rho > 0:
            return
        z /= norm
        values, vectors = self.values, self.vectors
        tol = 8 * EPS * max(values[-1], rho)
        z[rho * np.abs(z) <= tol] = 0
        rotate_equal(values, z, vectors, tol)
        z[rho * np.abs(z) <= tol] = 0
        at = np.flatnonzero(z)
        if len(at):
            poles = values[at]
            roots, apart = secular_roots(poles, rho * z[at] ** 2)
            between = np.abs(poles[:, None] - poles)
            np.fill_diagonal(between, 1)
            exact = np.sqrt(np.prod(np.abs(apart) / between, axis=0)) * np.sign(z[at])
            new = exact / apart
            new /= np.sqrt(np.sum(new * new, axis=1))[:, None]
            vectors[:, at] = vectors[:, at] @ new.T
            values[at] = roots
            if np.any(values[1:] < values[:-1]):
                order = np.argsort(values, kind="stable")
                self.values, self.vectors = values[order], vectors[:, order]


@dataclass
class Moments:
    """Count, exact sums and centred scatter (as a spectrum) of vectors."""

    n: int
    sums: np.ndarray
    spectrum: Spectrum

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.spectrum.add((self.n * x - self.sums) / self.n, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def merge(self, other: Moments) -> None:
        for value, vector in zip(other.spectrum.values, other.spectrum.vectors.T):
            if value > 0:
                self.spectrum.add(vector, float(value))
        base = self.sums // self.n  # means from small numbers, which lose nothing in the division
        apart = (other.sums - base * other.n) / other.n - (self.sums - base * self.n) / self.n
        self.spectrum.add(apart, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def to_bytes(self) -> bytes:
        return b"".join((np.int64(self.n).tobytes(), self.sums.tobytes(), self.spectrum.values.tobytes(), self.spectrum.vectors.tobytes()))

    @classmethod
    def from_bytes(cls, state: bytes, d: int) -> Moments:
        whole, real = np.frombuffer(state, np.int64, 1 + d), np.frombuffer(state, float, d + d * d, 8 * (1 + d))
        return cls(int(whole[0]), whole[1:].copy(), Spectrum(real[:d].copy(), real[d:].reshape(d, d).copy()))


@dataclass
class Model:
    """Means as exact sums over n; eigenvalues (falling) and unit
    eigenvectors (columns) of the covariance; its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the difference of integers before the division, so it is exact to the last bit."""
        base = self.sums // self.n
        return (x - base) - (self.sums - base * self.n) / self.n

    def kept(self, components: int) -> int:
        """Components whose eigenvalue is not zero to working precision."""
        d = len(self.values)
        return min(components, int(np.sum(self.values > d * 4 * EPS * max(self.trace, EPS))))


def _usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id and vector of the rows that count, the dimension)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(_usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return rows.where(F.size("vector") == d), d


def integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as rows of x."""
    x = np.floor(64 * batch.column(1).flatten().to_numpy().reshape(-1, d))
    if len(x) and np.abs(x).max() > 2.0**40:
        raise OverflowError("an embedding has an entry beyond 2^40")
    return x.astype(np.int64) + SHIFT


def gathered(rows: DataFrame, d: int, start: Callable, step: Callable, to_bytes: Callable, from_bytes: Callable, merge: Callable,
             name: str, fan_in: int = 16):
    """One state for all rows: `step(state, x)` folds each batch into a
    task's state, `merge(state, other)` combines states in a tree of groups
    of `fan_in`. None for no rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(start() if state is None else state, integers(batch, d))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "state": [to_bytes(state)]}, PARTIALS)

    def combine(table: pa.Table) -> pa.Table:
        states = sorted(table.column("state").to_pylist())  # one order, whatever the shuffle's
        state = from_bytes(states[0])
        for other in states[1:]:
            state = merge(state, from_bytes(other))
        return pa.table({"part": table.column("part")[:1], "state": [to_bytes(state)]}, PARTIALS)

    now = stored(rows.mapInArrow(fold, PARTIAL), name)
    while (now.agg(F.max("part")).first()[0] or 0) > 0:  # a group has `fan_in` task numbers, so at most as many rows
        now = stored(now.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(combine, PARTIAL), name)
    last = now.first()
    return from_bytes(bytes(last.state)) if last else None


def fit(rows: DataFrame, d: int, fan_in: int = 16) -> Model | None:
    """The model of usable rows (id, vector) of dimension d; None for no rows."""

    def each(moments: Moments, x: np.ndarray) -> Moments:
        for row in x:
            moments.add(row)
        return moments

    def merged(a, b):
        a.merge(b)
        return a

    moments = gathered(rows, d, lambda: Moments(0, np.zeros(d, np.int64), Spectrum.zero(d)), each, Moments.to_bytes,
                       lambda s: Moments.from_bytes(s, d), merged, "spectra", fan_in)
    if moments is None:
        return None
    basis = np.linalg.qr(moments.spectrum.vectors)[0]
    draft = Model(moments.n, moments.sums, moments.spectrum.values, basis, 0.0)
    small = _summed(rows, d, lambda x: (y := draft.centred(x) @ basis).T @ y, (d, d), "ritz", fan_in) / moments.n
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    falling = np.argsort(-values, kind="stable")
    return Model(moments.n, moments.sums, np.maximum(values[falling], 0), (basis @ vectors)[:, falling], float(np.trace(small)))


def _summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple, name: str, fan_in: int) -> np.ndarray:
    """The sum of `of(x)` over all batches."""
    return gathered(rows, d, lambda: np.zeros(shape), lambda state, x: state + of(x), np.ndarray.tobytes,
                    lambda s: np.frombuffer(s, float).reshape(shape), np.add, name, fan_in)


def identity_error(rows: DataFrame, d: int, model: Model, k: int, fan_in: int = 16) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    project = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def of(x):
        y = np.column_stack([model.centred(x) @ project, np.ones(len(x))])
        return y.T @ y

    total = _summed(rows, d, of, (k + 1, k + 1), "whitened", fan_in)
    mean = total[:k, k] / model.n
    return float(np.max(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)), initial=0))


def _deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact."""
    base = model.sums // model.n
    small, rest = x - base, model.sums - base * model.n
    if len(x) and (int(np.abs(small).max()) + 1) ** 2 * model.n ** 2 * x.shape[1] < 2**63:
        return np.sum((model.n * small - rest) ** 2, axis=1)
    return np.array([sum((model.n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in small], object)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: the id column, component
    (from 1), n, deviation, whitened, explained and identity_error."""
    rows, d = usable(vectors, id_col, vector_col)
    model = fit(rows, d) if d else None
    k = model.kept(components) if model else 0
    names = (F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained")
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).select(*names, F.lit(0.0).alias("identity_error"))
    error = identity_error(rows, d, model, k)
    project, share = model.vectors[:, :k] / np.sqrt(model.values[:k]), model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = integers(part, d)
                m = len(x)
                places = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(_deviations(x, model), pa.int64()).take(places),
                    pa.array((model.centred(x) @ project).ravel()), pa.array(np.tile(share, m))], schema=WHITENED)

    return rows.mapInArrow(run, schema).select(*names, F.lit(error).alias("identity_error"))
