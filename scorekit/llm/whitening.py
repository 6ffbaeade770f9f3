"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of its own scatter matrix, ``sum (x - mean)(x - mean)^T``, as
eigenvalues and eigenvectors, and takes its rows in one by one: a row changes the scatter by a
centred rank-one term, ``m / (m + 1) * (x - mean)(x - mean)^T``. The new eigenvalues are the roots
of the secular equation ``1 + rho * sum z_i^2 / (d_i - t) = 0``, one between each two old ones, found
for all places at once by interpolating each side with a pole; places where ``z_i`` is negligible, or
where eigenvalues coincide (rotated together), are deflated and stay as they are. The vector ``z`` is
then recomputed from the roots, which makes the new eigenvectors orthogonal to working precision.

Two spectra are combined in the same way: the second's eigenpairs enter the first as successive
rank-one updates, and one more accounts for the two means. Partitions combine in groups of ``FAN``,
level by level, so no task meets more than ``FAN`` spectra. A last pass over all rows projects them
on the combined basis and solves that small problem (Rayleigh-Ritz); the basis is whole, so this
makes the eigenpairs right to double precision.

Entries are whole numbers. Their count and sums are exact, and all floating-point work is done on
entries less the mean's integer part, so a large common offset costs no digits. Spectra have
``dimensions ** 2`` numbers (33 KB at 64); the driver holds one, and two matrices of that size.

Cases: rows whose vector is null or empty, or holds a null, NaN or infinite entry, are dropped;
vectors must share one length: rows of another length than the most frequent one (of equals: the
greatest) are dropped; components whose eigenvalue is zero to rounding have no whitened values and
are not returned, so equal vectors only, or one row, give an empty result; rows of one id each
count and are returned; a deviation that does not fit a long is null; scaled entries of 2**40
or more are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.llm.vectors import list_column, matrix, summed_entries, whole_vectors
from scorekit.session import delete_tables, materialize

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 40
COMPONENTS = 32
FAN = 8                # spectra combined in one task
EPS = np.finfo(float).eps
SECULAR_STEPS = 60
OUT_ROWS = 2048        # vectors projected at a time


# ------------------------------------------------------------------ rank-one updates
def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum z2_j / (d_j - t)`` for increasing ``d``, ``rho > 0``, ``z2 > 0``.

    Returned as ``pole, shift``: root ``i`` is ``d[pole_i] + shift_i``, the nearer pole, so that its
    distance to every pole keeps its digits.
    """
    n = len(d)
    place = np.arange(n)
    top = d[-1] + rho * z2.sum()
    upper = np.append(d[1:], top)
    middle = (d + upper) / 2
    at_middle = 1 / rho + (z2 / (d - middle[:, None])).sum(axis=1)
    pole = np.where((at_middle >= 0) | (place == n - 1), place, np.minimum(place + 1, n - 1))
    delta = d[None, :] - d[pole][:, None]
    left, right = d - d[pole], upper - d[pole]
    inner = middle - d[pole]
    lo = np.where(pole == place, left, inner)
    hi = np.where((pole == place) & (place < n - 1), inner, right)
    shift = (lo + hi) / 2
    below = place[None, :] <= place[:, None]
    low, high = np.where(below, z2, 0.0), np.where(below, 0.0, z2)
    for _ in range(SECULAR_STEPS):
        gap = delta - shift[:, None]
        inverse = 1.0 / gap
        psi, phi = (low * inverse), (high * inverse)
        psi_sum, phi_sum = psi.sum(axis=1), phi.sum(axis=1)
        f = 1 / rho + psi_sum + phi_sum
        lo, hi = np.where(f < 0, shift, lo), np.where(f < 0, hi, shift)
        done = (np.abs(f) <= 4 * EPS * n * (1 / rho + phi_sum - psi_sum)) | (hi - lo <= 2 * EPS * np.abs(shift))
        if done.all():
            break
        # Each side is replaced by a constant and one pole that match its value and slope here.
        a, b = left - shift, right - shift
        s, big_s = (psi * inverse).sum(axis=1) * a * a, (phi * inverse).sum(axis=1) * b * b
        c = f - s / a - np.where(place < n - 1, big_s / b, 0.0)
        linear = c * (a + b) + s + big_s
        constant = a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(linear * linear - 4 * c * constant, 0))
            step = np.where(linear <= 0, (linear - root) / (2 * c), 2 * constant / (linear + root))
            step[-1] = a[-1] + s[-1] / c[-1]
        new = shift + step
        bad = ~((new > lo) & (new < hi))
        shift = np.where(done, shift, np.where(bad, (lo + hi) / 2, new))
    return pole, shift


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors * values * vectors^T + rho * x x^T``."""
    z = vectors.T @ x
    size = float(z @ z)
    if rho <= 0 or size == 0:
        return values, vectors
    z, rho = z / np.sqrt(size), rho * size
    least = 8 * EPS * max(float(np.abs(values).max(initial=0)), rho)
    live = np.flatnonzero(rho * np.abs(z) > least)
    if len(live) > 1 and (np.diff(values[live]) <= least).any():
        vectors, last = vectors.copy(), live[0]
        for j in live[1:]:  # rotate coinciding eigenvalues' vectors together: one keeps the weight
            if values[j] - values[last] <= least:
                r = np.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                a, b = vectors[:, last].copy(), vectors[:, j].copy()
                vectors[:, last], vectors[:, j] = c * a - s * b, s * a + c * b
                z[last], z[j] = 0.0, r
            last = j
        live = np.flatnonzero(rho * np.abs(z) > least)
    if not len(live):
        return values, vectors
    d, zl = values[live], z[live]
    pole, shift = secular_roots(d, zl * zl, rho)
    gap = (d[None, :] - d[pole][:, None]) - shift[:, None]  # row i: poles less root i
    # z from the roots: prod_i (root_i - d_j) / prod_{i != j} (d_i - d_j), in pairs near one.
    ratio = -gap
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    z_new = np.sqrt(np.abs(np.prod(ratio / apart, axis=0)))
    u = np.copysign(z_new, zl)[None, :] / gap
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    values, new_vectors = values.copy(), vectors.copy()
    values[live], new_vectors[:, live] = d[pole] + shift, vectors[:, live] @ u.T
    order = np.argsort(values, kind="stable")
    return values[order], new_vectors[:, order]


class Spectrum:
    """Count, mean, and eigenpairs of the scatter matrix of the rows taken in."""

    def __init__(self, dimensions: int):
        self.count, self.mean = 0, np.zeros(dimensions)
        self.values, self.vectors = np.zeros(dimensions), np.eye(dimensions)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.count / (self.count + 1))
        self.count += 1
        self.mean = self.mean + off / self.count

    def merge(self, other: "Spectrum") -> None:
        if not other.count:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        total, off = self.count + other.count, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.count * other.count / total)
        self.mean = self.mean + off * (other.count / total)
        self.count = total

    def row(self) -> list:
        return [self.count, self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()]

    @classmethod
    def of_row(cls, count, mean, values, vectors) -> "Spectrum":
        out = cls(len(mean))
        out.count, out.mean, out.values = count, np.array(mean), np.array(values)
        out.vectors = np.array(vectors).reshape(len(mean), -1)
        return out


_SPECTRUM = "count bigint, mean array<double>, eigenvalues array<double>, vectors array<double>"
_ARROW = pa.schema([("count", pa.int64()), ("mean", pa.list_(pa.float64())),
                    ("eigenvalues", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _spectra(shift: np.ndarray):
    def task(batches):
        state = Spectrum(len(shift))
        for batch in batches:
            if batch.num_rows:
                for x in (matrix(batch.column("x")) - shift).astype(float):
                    state.add(x)
        if state.count:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(state.row(), _ARROW)],
                                             schema=_ARROW)
    return task


def _merged(table: pa.Table) -> pa.Table:
    state = None
    for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
        own = Spectrum.of_row(r["count"], r["mean"], r["eigenvalues"], r["vectors"])
        if state is None:
            state = own
        else:
            state.merge(own)
    return pa.table([pa.array([v], type=t) for v, t in zip(
        [table.column("parent")[0].as_py(), *state.row()], [pa.int64(), *(f.type for f in _ARROW)])],
        names=["part", *_ARROW.names])


def combined_spectrum(x: DataFrame, shift: np.ndarray) -> Spectrum:
    """The spectrum of all rows of ``x``, from partitions' spectra combined level by level."""
    parts = materialize(x.select("x").mapInArrow(_spectra(shift), _SPECTRUM)
                        .withColumn("part", F.spark_partition_id().cast("bigint")), "spectra")
    level, widest = parts, parts.agg(F.max("part")).first()[0]
    while widest > 0:
        level = (level.withColumn("parent", F.floor(F.col("part") / FAN)).groupBy("parent")
                 .applyInArrow(_merged, f"part bigint, {_SPECTRUM}"))
        widest //= FAN
    r = level.first()
    delete_tables(x.sparkSession, parts)
    return Spectrum.of_row(r["count"], r["mean"], r["eigenvalues"], r["vectors"])


# ------------------------------------------------------------------ passes over the rows
def _centred(x: np.ndarray, n: int, shift: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x - S / n``, where ``S = n * shift + rest``: whole numbers up to the one division."""
    return (n * (x - shift) - rest) / n


def _products(n, shift, rest, basis):
    """Sums of products of the columns of ``(x - S / n) * basis`` over a partition."""
    def task(batches):
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            x = matrix(batch.column("x"))
            for at in range(0, len(x), OUT_ROWS):
                y = _centred(x[at:at + OUT_ROWS], n, shift, rest) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([list_column(total.reshape(1, -1), pa.float64())], names=["products"])
    return task


def _covariance(x, n, shift, rest, basis) -> np.ndarray:
    size = basis.shape[1]
    parts = x.select("x").mapInArrow(_products(n, shift, rest, basis), "products array<double>")
    out = np.zeros(size * size)
    for r in summed_entries(parts, [], "products", "double").collect():  # size ** 2 rows
        out[r["place"]] = r["total"]
    out = out.reshape(size, size) / n
    return (out + out.T) / 2


def deviations(x: np.ndarray, n: int, shift: np.ndarray, rest: np.ndarray) -> list:
    """Exact ``sum (n * x - S) ** 2`` of each row; None where it does not fit a long."""
    off = x - shift
    if int(np.abs(off).max(initial=0) + 1) ** 2 * n * n * x.shape[1] < 1 << 62:
        off = n * off - rest
        return np.einsum("ij,ij->i", off, off)
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest)) for row in off]
    return [v if v < 1 << 63 else None for v in exact]


def _sums(batches):
    count, total = 0, None
    for batch in batches:
        x = matrix(batch.column("x"))
        if len(x):
            own = x.sum(axis=0)
            count, total = count + len(x), own if total is None else total + own
    if count:
        yield pa.RecordBatch.from_arrays([list_column(np.append(total, count)[None], pa.int64())], names=["total"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every kept row
    and component."""
    spark = vectors.sparkSession
    result = T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType), *T._parse_datatype_string(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    kept = whole_vectors(vectors, scale, LARGEST, id_col, vector_col).select(
        "vec_id", F.transform("x", lambda e: e + offset).alias("x")).where(F.size("x") > 0)
    length = (kept.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
              .orderBy(F.desc("rows"), F.desc("size")).first())
    if length is None:
        return spark.createDataFrame([], result)
    size = length["size"]
    kept = kept.where(F.size("x") == size)
    sums = {r["place"]: int(r["total"]) for r in summed_entries(
        kept.select("x").mapInArrow(_sums, "total array<bigint>"), [], "total", "decimal(38,0)").collect()}
    n = sums.pop(size)
    shift = np.array([sums[i] // n for i in range(size)], dtype=np.int64)
    rest = np.array([sums[i] % n for i in range(size)], dtype=np.int64)

    basis, _ = np.linalg.qr(combined_spectrum(kept, shift).vectors[:, ::-1])
    values, turn = np.linalg.eigh(_covariance(kept, n, shift, rest, basis))
    values, basis = values[::-1], basis @ turn[:, ::-1]
    trace = values.sum()
    used = int((values[:components] > max(values[0], 0) * size * size * EPS).sum())
    if not used:
        return spark.createDataFrame([], result)
    explained, project = values[:used] / trace, basis[:, :used] / np.sqrt(values[:used])
    error = float(np.abs(_covariance(kept, n, shift, rest, project) - np.eye(used)).max())

    def task(batches):
        number = np.arange(1, used + 1, dtype=np.int32)
        for batch in batches:
            x = matrix(batch.column("x"))
            for at in range(0, len(x), OUT_ROWS):
                own = x[at:at + OUT_ROWS]
                rows = len(own)
                each = np.repeat(np.arange(rows), used)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").slice(at, rows).take(pa.array(each)),
                    pa.array(np.tile(number, rows)), pa.array(np.full(rows * used, n, np.int64)),
                    pa.array(deviations(own, n, shift, rest), pa.int64()).take(pa.array(each)),
                    pa.array((_centred(own, n, shift, rest) @ project).ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * used, error))],
                    names=result.names)

    return kept.mapInArrow(task, result)
