"""Whitening of embeddings by an eigendecomposition that takes the vectors one at a time.

Each partition of the distinct vectors keeps the spectrum of what it has seen: how many, their
mean, eigenvectors and eigenvalues of the scatter about the mean. A further vector, centred by
the mean so far, changes the scatter by a matrix of rank one; the new eigenvalues are the roots
of a secular equation, and components that the vector doesn't touch, or that share an eigenvalue,
are deflated. Spectra are combined in groups, round by round and in tasks, by the same step: one for
each eigenvector of the smaller spectrum and one for the difference of the means. The last spectrum's vectors are the basis of a
Rayleigh-Ritz refinement: a pass over the vectors, centred exactly, adds up their covariance in
that basis, and its eigenvectors turn the basis into the components.

Vectors are whole numbers x = floor(64 c) + 1000000, so n and the sums S by dimension are exact, and
n x - S is, too. What passes through the driver is bounded by the square of the dimension alone.

Defined cases: rows with a null vector, an empty one, or null or non-finite entries are dropped, and so are rows
whose vector is not of the most frequent length (the longer on ties). Rows with equal vectors count
once for the fit and each give their rows. Components whose eigenvalue is zero to double
precision can't be whitened and are left out, so a single distinct vector gives no row, nor does
an empty table. A squared deviation beyond 63 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class WhitenRules:
    components: int = 16
    #: Spectra that a task combines in a round.
    fan_in: int = 8
    #: Vectors of a partition of the fit at least; fewer, larger ones mean fewer spectra to combine.
    partition_rows: int = 2_000


@dataclass
class Spectrum:
    """Count, mean, eigenvectors (columns) and ascending eigenvalues of the scatter about the mean."""

    n: int
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.eye(d), np.zeros(d))

    def turn(self, v: np.ndarray) -> None:
        """The scatter plus the outer product of ``v`` with itself."""
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def add(self, x: np.ndarray) -> None:
        """One vector more."""
        gap = x - self.mean
        self.turn(gap * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def absorb(self, other: Spectrum) -> None:
        """The vectors of another spectrum more."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > EPS * other.values[-1]:
                self.turn(np.sqrt(value) * vector)
        gap, total = other.mean - self.mean, self.n + other.n
        self.turn(gap * np.sqrt(self.n * other.n / total))
        self.n, self.mean = total, self.mean + gap * (other.n / total)


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of vectors diag(values) vectors' + v v'."""
    z = v @ vectors
    size = z @ z
    if size == 0:
        return values, vectors
    tiny = 8 * EPS * max(values[-1], size)
    values, vectors = values.copy(), vectors.copy()
    # a run of equal eigenvalues is reflected so that only its last vector meets v
    equal = np.flatnonzero(np.diff(values) > tiny) + 1
    for a, b in zip([0, *equal], [*equal, len(values)], strict=True):
        if b - a > 1:
            part = z[a:b]
            norm = np.linalg.norm(part)
            if norm > 0:
                w = part.copy()
                w[-1] += norm if w[-1] >= 0 else -norm
                ww = w @ w
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, w) * (2 / ww)
                z[a : b - 1], z[b - 1] = 0, (-norm if part[-1] >= 0 else norm)
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    if len(live):
        d, weights = values[live], z[live]
        roots, gaps = secular_roots(d, weights)
        values[live] = roots
        # weights for which these roots are exact keep the new vectors orthogonal
        with np.errstate(divide="ignore"):
            spread = d[:, None] - d[None, :]
            np.fill_diagonal(spread, 1.0)
            fixed = np.sign(weights) * np.exp(0.5 * (np.log(np.abs(gaps)).sum(axis=1) - np.log(np.abs(spread)).sum(axis=1)))
        turned = fixed[:, None] / gaps
        turned /= np.linalg.norm(turned, axis=0)
        vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots r of 1 + sum z_i^2 / (d_i - r) = 0 for ascending, distinct d and z without zeros; and the differences d_i - r_j.

    A root lies above each d_i, below the next, the last within |z|^2. Each is sought from the pole it
    is nearer to, so that differences keep their digits, by interpolation with a rational function that
    has both poles around it; where that leaves the bracket, by halving it.
    """
    k, squares = len(d), z * z
    upper = np.append(d[1:], d[-1] + squares.sum())
    width = upper - d
    middle = 1 + (squares[:, None] / (d[:, None] - (d + width / 2)[None, :])).sum(axis=0)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    poles = d[:, None] - origin[None, :]
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, width / 2, 0.0)
    high[-1] = width[-1] * (1 + 8 * EPS)
    near, far = d - origin, upper - origin
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]
    root = (low + high) / 2
    for _ in range(80):
        inverse = 1.0 / (poles - root)
        terms = squares[:, None] * inverse
        slopes = terms * inverse
        value, rise = 1 + terms.sum(axis=0), slopes.sum(axis=0)
        low, high = np.where(value < 0, root, low), np.where(value > 0, root, high)
        rise_low = np.where(below, slopes, 0).sum(axis=0)
        to_near, to_far = near - root, far - root
        # value + slope are matched by c + s / (near - r) + S / (far - r)
        c = value - to_near * rise_low - to_far * (rise - rise_low)
        a = (to_near + to_far) * value - to_near * to_far * rise
        b = to_near * to_far * value
        with np.errstate(all="ignore"):
            under = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - under) / (2 * c), 2 * b / (a + under))
            # the last root has a pole on one side only, so a constant and that pole are matched
            step[-1] = to_near[-1] + rise[-1] * to_near[-1] ** 2 / (value[-1] - rise[-1] * to_near[-1])
        moved = root + step
        wild = ~(np.isfinite(moved) & (moved > low) & (moved < high))
        moved[wild] = (low[wild] + high[wild]) / 2
        settled = (np.abs(value) <= 8 * EPS * (1 + np.abs(terms).sum(axis=0))) | (high - low <= 4 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if settled.all():
            break
        root = np.where(settled, root, moved)
    return origin + root, poles - root


def whole_numbers(vector: Column) -> Column:
    """x of a vector of numbers; null if it is null, empty or holds null or non-finite entries."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _stack(rows: list[Spectrum]) -> pa.RecordBatch:
    flat = [np.concatenate([[s.n], s.mean, s.vectors.ravel(), s.values]) for s in rows]
    return pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in flat], pa.binary())], ["spectrum"])


def _spectrum(raw: bytes, d: int) -> Spectrum:
    flat = np.frombuffer(raw)
    return Spectrum(int(flat[0]), flat[1 : d + 1].copy(), flat[d + 1 : d + 1 + d * d].reshape(d, d).copy(), flat[d + 1 + d * d :].copy())


def incremental_spectrum(fit: DataFrame, d: int, centre: np.ndarray, rules: WhitenRules = WhitenRules()) -> Spectrum:
    """The spectrum of the vectors ``x`` of ``fit``, less ``centre``, by rank-one updates in partitions and combinations in rounds."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum.empty(d)
        for batch in batches:
            for x in _matrix(batch.column(0), d):
                seen.add((x - centre).astype(float))
        if seen.n:
            yield _stack([seen])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for raw in batch.column(0):
                one = _spectrum(raw.as_py(), d)
                if seen is None:
                    seen = one
                else:
                    seen.absorb(one)
        if seen is not None:
            yield _stack([seen])

    spectra = written(fit.select("x").mapInArrow(take, "spectrum binary"))
    left = spectra.count()
    while left > 1:
        left = -(-left // rules.fan_in)
        spectra = written(spectra.repartition(left).mapInArrow(combine, "spectrum binary"))
        left = spectra.count()
    found = spectra.collect()
    return _spectrum(found[0]["spectrum"], d) if found else Spectrum.empty(d)


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """The sums of the entries of ``part``, an array of so many numbers for each partition of a pass over the vectors."""
    each = rows.select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in each.collect():
        out[r["k"]] = r["v"]
    return out


def _second_moments(fit: DataFrame, d: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of the vectors, centred exactly, in a basis (columns)."""
    k = basis.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    total = _summed(fit.select("x").mapInArrow(add, "part array<double>"), k * k).reshape(k, k) / n
    return (total + total.T) / 2


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from n x - S, which is exact."""
    return (x * n - sums).astype(float) / n


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    #: The incremental eigenvalues before the refinement, ascending.
    incremental: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fit_whitening(rows: DataFrame, rules: WhitenRules = WhitenRules()) -> Whitening | None:
    """Components of the distinct vectors ``x`` (long arrays of one length) of ``rows``; None without vectors that differ."""
    fit = written(rows.select("x").groupBy("x").agg(F.lit(1).alias("_one")).select("x"))
    head = fit.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    d = head["d"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total[0] += len(x)
            total[1:] += x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([[int(t) for t in total]], pa.list_(pa.int64()))], ["part"])

    each = fit.mapInArrow(add, "part array<long>").select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    totals = [int(r["v"]) for r in sorted(each.collect())]
    n, sums = totals[0], np.array(totals[1:], np.int64)
    spread = fit.rdd.getNumPartitions()
    packed = fit.coalesce(max(1, min(spread, n // rules.partition_rows))) if n // rules.partition_rows < spread else fit
    spectrum = incremental_spectrum(packed, d, np.array([t // n for t in totals[1:]], np.int64), rules)
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    covariance = _second_moments(fit, d, n, sums, basis)
    values, turned = np.linalg.eigh(covariance)
    values, vectors = values[::-1], basis @ turned[:, ::-1]
    trace = values.sum()
    rank = int((values > d * EPS * max(values[0], 0) * 16).sum()) if trace > 0 else 0
    if not rank:
        return None
    k = min(rules.components, rank)
    vectors = vectors[:, :k] * np.where(np.take_along_axis(vectors[:, :k], np.abs(vectors[:, :k]).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    white = _second_moments(fit, d, n, sums, vectors / np.sqrt(values[:k]))
    return Whitening(n, sums, vectors, values[:k], values[:k] / trace, float(np.abs(white - np.eye(k)).max()), spectrum.values / n)


def whitened(table: DataFrame, rules: WhitenRules = WhitenRules()) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the rows of a table (vec_id, embedding) with a sound vector."""
    rows = table.select("vec_id", whole_numbers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"vec_id {dict(table.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = None
    if lengths is not None:
        rows = rows.where(F.size("x") == lengths["d"])
        fitted = fit_whitening(rows, rules)
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema)
    n, sums, projection, k = fitted.n, fitted.sums, fitted.components / np.sqrt(fitted.values), len(fitted.values)
    limit = (2.0**63 - 1) / len(sums)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                x = _matrix(part.column(1), len(sums))
                gap = x * n - sums
                if len(gap) and float(np.abs(gap).max()) ** 2 > limit:
                    raise OverflowError("a squared deviation is beyond 63 bits")
                y = (gap.astype(float) / n) @ projection
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(np.repeat((gap * gap).sum(axis=1), k)),
                    pa.array(y.ravel()), pa.array(np.tile(fitted.explained, len(x))), pa.array(np.full(len(x) * k, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(score, schema)
