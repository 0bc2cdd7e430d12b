"""Whitening of embeddings by an incremental eigendecomposition, merged over partitions and refined at the end.

Each task keeps the eigenvalues and eigenvectors of its rows' scatter matrix: a row is one centred rank-one update,
whose new eigenvalues are the roots of a secular equation (small and equal parts are deflated first). Spectra of two
tasks are combined by one rank-one update for each eigenvector of the other and one for the difference of the means;
groups of FAN meet, until one spectrum remains. Its eigenvectors span the space in which the covariance of all rows is
then taken, with exact sums as the centre: the Rayleigh-Ritz refinement, after which the components are those of the
whole covariance to double precision. What travels is a few matrices of dimension x dimension per task, summed in
groups; the driver holds one of them.
Bunch, Nielsen and Sorensen, Rank-one modification of the symmetric eigenproblem, Numerische Mathematik 1978; Gu and
Eisenstat, A stable and efficient algorithm for the rank-one modification of the symmetric eigenproblem, 1994.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint

#: Entries become integers floor(SCALE * entry) + SHIFT; beyond LARGEST they stay at it.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 44)
COMPONENTS = 32
#: Spectra, and sums, that meet in one task.
FAN = 8

_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - root)) = 0, and the differences d[j] - root[i] to full relative accuracy.

    ``d`` rises strictly, no z is 0 and rho is positive. Each root is sought from the nearer of its two poles, by
    matching a rational function with these poles to the parts of the sum below and above it.
    """
    n, z2 = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    middle = (d + upper) / 2
    at_middle = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    low_side = at_middle >= 0
    low_side[-1] = True
    origin = np.where(low_side, d, upper)
    poles = d[:, None] - origin[None, :]
    gap = upper - d
    lo = np.where(low_side, 0.0, -gap / 2)
    hi = np.where(low_side, np.where(np.arange(n) == n - 1, gap * (1 + 4 * _EPS), gap / 2), 0.0)
    mu = (lo + hi) / 2
    index = np.arange(n)
    below = (index[:, None] <= index[None, :]).astype(float)
    following = np.minimum(index + 1, n - 1)
    for _ in range(60):
        delta = poles - mu
        part = z2[:, None] / delta
        slope = part / delta
        psi, phi = np.where(below, part, 0).sum(0), np.where(below, 0, part).sum(0)
        dpsi, dphi = np.where(below, slope, 0).sum(0), np.where(below, 0, slope).sum(0)
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        open_ = np.abs(f) > 4 * n * _EPS * (1 - psi + phi)
        if not open_.any():
            break
        left, right = delta[index, index], delta[following, index]
        a = (left + right) * f - left * right * (dpsi + dphi)
        b = left * right * f
        c = f - left * dpsi - right * dphi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = left[-1] + left[-1] ** 2 * dpsi[-1] / (1 + psi[-1] - left[-1] * dpsi[-1])
            new = mu + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        mu = np.where(open_, new, mu)
    return origin + mu, poles - mu


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors @ diag(values) @ vectors.T + rho * u u.T, where z = vectors.T @ u."""
    norm = np.sqrt(z @ z)
    if not norm or not rho:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    small = 8 * _EPS * max(values[-1], rho)
    live = np.flatnonzero(rho * np.abs(z) > small)
    if not len(live):
        return values, vectors
    if (np.diff(values[live]) <= small).any():
        vectors, kept, before = vectors.copy(), [], live[0]
        for k in live[1:]:
            if values[k] - values[before] <= small:  # equal values: turn the pair so that only one of them has a part in u
                r = np.hypot(z[before], z[k])
                c, s = z[k] / r, z[before] / r
                vectors[:, [before, k]] = vectors[:, [before, k]] @ np.array([[c, s], [-s, c]])
                z[before], z[k] = 0.0, r
            else:
                kept.append(before)
            before = k
        live = np.array([*kept, before])
    d, part = values[live], z[live]
    roots, delta = secular_roots(d, part, rho)
    # The vector for which these roots are exact; its eigenvectors are orthogonal however close the roots lie.
    n = len(d)
    poles = np.where(np.arange(n - 1)[None, :] < np.arange(n)[:, None], d[:-1][None, :], d[1:][None, :]) - d[:, None]
    exact = np.sqrt(np.abs(np.prod(delta[:, :-1] / poles, axis=1) * delta[:, -1] / rho)) * np.sign(part)
    turned = exact[:, None] / delta
    turned /= np.sqrt((turned * turned).sum(0))
    values, changed = values.copy(), vectors.copy()
    values[live], changed[:, live] = roots, vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], changed[:, order]


class Spectrum:
    """Number, mean and scatter matrix (as eigenvalues and eigenvectors) of some rows."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def of(cls, row: np.ndarray) -> Spectrum:
        return cls(1, row.astype(float), np.zeros(len(row)), np.eye(len(row)))

    def _update(self, rho: float, direction: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, rho, self.vectors.T @ direction)

    def add(self, row: np.ndarray) -> None:
        off = row - self.mean
        self._update(self.n / (self.n + 1), off)
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        off, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(value, vector)
        self._update(self.n * other.n / n, off)
        self.mean, self.n = self.mean + off * (other.n / n), n


def cleaned(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array of doubles that are integers) of the rows that can be used."""
    entry = lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False))
    usable = F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.coalesce(F.forall(vector_col, entry), F.lit(False))
    scaled = lambda e: F.greatest(F.least(e.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform(vector_col, lambda e: F.floor(scaled(e)).cast("double") + SHIFT)
    return vectors.filter(usable).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spectra(rows: DataFrame) -> DataFrame:
    """slot, n, sums (exact), mean, values, vectors (packed doubles) of the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch["x"])
            for begin in range(0, len(matrix), 4096):  # 2^12 entries of 2^45 at most have an exact sum
                sums = sums + matrix[begin : begin + 4096].astype(np.int64).sum(0).astype(object)
            for row in matrix:
                if found is None:
                    found = Spectrum.of(row)
                else:
                    found.add(row)
        if found is not None:
            row = {"slot": TaskContext.get().partitionId(), "n": found.n, "sums": [Decimal(int(s)) for s in sums]}
            row |= {k: getattr(found, k).tobytes() for k in ("mean", "values", "vectors")}
            yield pa.RecordBatch.from_pylist([row], _SPECTRUM_ARROW)

    return rows.select("x").mapInArrow(run, _SPECTRUM)


_SPECTRUM = "slot long, n long, sums array<decimal(38,0)>, mean binary, values binary, vectors binary"
_SPECTRUM_ARROW = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())])


def _combined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("slot")
    both, sums = None, 0
    for r in group.itertuples():
        values = np.frombuffer(r.values, float)
        one = Spectrum(r.n, np.frombuffer(r.mean, float), values, np.frombuffer(r.vectors, float).reshape(len(values), -1))
        sums = sums + np.array([int(s) for s in r.sums], object)
        if both is None:
            both = one
        else:
            both.merge(one)
    return pd.DataFrame([(group["slot"].iloc[0] // FAN, both.n, [Decimal(int(s)) for s in sums], both.mean.tobytes(), both.values.tobytes(), both.vectors.tobytes())], columns=["slot", "n", "sums", "mean", "values", "vectors"])


def _met(frame: DataFrame, combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> list:
    """The one row that is left after rows with a ``slot`` have met FAN by FAN (none: no row)."""
    frame = checkpoint(frame)
    while (top := frame.agg(F.max("slot")).first()[0]) is not None and top > 0:
        frame = checkpoint(frame.groupBy(F.floor(F.col("slot") / FAN).alias("at")).applyInPandas(combine, schema))
    return frame.collect()


def _added(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("slot")
    total = np.frombuffer(group["packed"].iloc[0], float).copy()
    for packed in group["packed"].iloc[1:]:
        total += np.frombuffer(packed, float)
    return pd.DataFrame([(group["slot"].iloc[0] // FAN, total.tobytes())], columns=["slot", "packed"])


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(matrix)`` over all rows; a task adds up its own, then sums meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(_matrix(batch["x"]))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "packed": pa.array([total.tobytes()], pa.binary())})

    schema = "slot long, packed binary"
    return np.frombuffer(_met(rows.select("x").mapInArrow(run, schema), _added, schema)[0]["packed"], float)


class Whitening:
    """The fitted components of some rows: unit vectors by falling eigenvalue, the exact centre, and the variances."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.floor = np.array([s // n for s in sums], float)
        self.rest = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n without the cancellation of a rounded mean."""
        return (x - self.floor) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - sums) ** 2) of each row, exact."""
        whole = x - self.floor  # an integer; n * x - sums is n times it, less the remainder
        most = self.n * (np.abs(whole).max(initial=0) + 1)
        remainder = [s % self.n for s in self.sums]
        if x.shape[1] * most * most < 2.0**62:
            return ((self.n * whole.astype(np.int64) - np.array(remainder, np.int64)) ** 2).sum(1).tolist()
        off = self.n * whole.astype(np.int64).astype(object) - np.array(remainder, object)
        return (off * off).sum(1).tolist()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of cleaned rows; None if there are none or all are equal.

    Directions in which the rows do not vary (within rounding) are no components.
    """
    met = _met(spectra(rows), _combined, _SPECTRUM)
    if not met:
        return None
    n, sums = met[0]["n"], [int(s) for s in met[0]["sums"]]
    dimension = len(sums)
    basis = np.linalg.qr(np.frombuffer(met[0]["vectors"], float).reshape(dimension, dimension)[:, ::-1])[0]
    centre = Whitening(n, sums, np.ones(dimension), basis, 1.0)

    def projected(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x) @ centre.vectors
        return (y.T @ y).ravel()

    ritz = _summed(rows, projected).reshape(dimension, dimension) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    kept = min(components, int((values > 64 * dimension * _EPS * max(values[0], 0)).sum()))
    return Whitening(n, sums, values[:kept], vectors[:, :kept], trace) if kept else None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact for each usable row and component.

    Rows are left out whose vector is null, empty, or holds a null or non-finite entry; if lengths differ, those not of
    the most frequent length (of equally frequent ones the longest). Entries c count as floor(64 c) + 1000000, 64 c kept
    within +-2^44. Repeated rows count each time; ids may be null or repeat; other columns are not read. There are at
    most ``components`` components, and none in which the rows do not vary: an empty table, a single row, or equal rows
    give no result rows. ``deviation`` is null where it passes 64 bits, ``deviation_exact`` beyond 38 digits.
    """
    rows = cleaned(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = None
    if lengths:
        rows = rows.filter(F.size("x") == lengths[0]["size"])
        model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = _summed(rows, moments) / model.n
    covariance = found[count:].reshape(count, count) - np.outer(found[:count], found[:count])
    identity_error = float(np.abs(covariance - np.eye(count)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x, size = _matrix(part["x"]), part.num_rows
                deviations = model.deviations(x)
                place = pa.array(np.repeat(np.arange(size), count))
                short = pa.array([v if v < 2**63 else None for v in deviations], pa.int64()).take(place)
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviations], pa.decimal128(38, 0)).take(place)
                columns = [part["vec_id"].take(place), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, model.n)), short]
                columns += [pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, identity_error)), exact]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(run, schema)
