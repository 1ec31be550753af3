"""Embedding whitening with eigenvalues isolated by spectrum slicing.

Entries become whole numbers (see `grid`), so counts, sums and second moments are
exact however the rows are dealt out. One pass gives the sums; a second gives the
products of entries centred on the whole number nearest to their mean, from which
the covariance follows by exact integer arithmetic.

The covariance is brought to tridiagonal form once. There an LDL' factorisation of
the covariance less a shift costs one division a dimension, and the signs of D count
the eigenvalues above the shift. Halving intervals by these counts isolates each
leading eigenvalue; Rayleigh quotient iteration on the covariance itself then
converges cubically, from a start that is orthogonal to the components found before.
The counts just beside each result certify that it is the eigenvalue of its number.
A group of eigenvalues closer than rounding is certified as a group.

The covariance, of which only the dimension decides the size, is the only thing that
passes the driver. Each task sends one row per dimension; tasks that add these rows
up read them as a stream.

Defined cases. Rows whose vector is null or empty, or holds null or non-finite
entries or entries beyond `LARGEST`, are dropped; so are vectors of another length
than most have (of lengths equally frequent, the longest). Ids may be null or
repeated; each row stands for itself. Components are those with an eigenvalue above
rounding: at most `components`, fewer if the vectors span fewer dimensions, none (and
so no rows) if all vectors are equal, if there is one, or if there is none. Equal
eigenvalues get any orthonormal vectors of their space, numbered in any order. A
deviation beyond a long is null. Only the named columns are read, so clashing names
do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import settle

SCALE, ORIGIN = 64, 1_000_000
#: Entries beyond this have no place on the grid of whole numbers.
LARGEST = 2.0**55
COMPONENTS = 32
EPS = np.finfo(float).eps
#: Halvings of a slice that holds one eigenvalue, and most steps of the iteration; some five are usual.
EXTRA, ITERATIONS = 6, 200
#: Rows of output held at a time.
OUTPUT_ROWS = 1 << 18
LONG = 2**63 - 1


# Exact sums over Spark ------------------------------------------------------


def grid(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as whole numbers floor(64 c) + 1000000, of the rows that remain; written once."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = docs.select(F.col(id_col).alias("vec_id"), entries.alias("c")).where(F.size("c") > 0)
    # a null entry makes the comparison null, which counts as unsound
    sound = F.forall("c", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST)), F.lit(False)))
    x = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + ORIGIN)
    whole = settle(rows.where(sound).select("vec_id", x.alias("x")), "grid")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return whole.where(F.size("x") == usual.d) if usual else whole


def _matrix(column) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(values: np.ndarray) -> bytes:
    """Integers of any size, or floats."""
    if values.dtype == object:
        return b"O" + ",".join(map(str, values.tolist())).encode()
    return values.dtype.char.encode() + values.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"O":
        return np.array([int(v) for v in raw[1:].split(b",")], object)
    return np.frombuffer(raw[1:], raw[:1].decode())


def _add_up(batches: Iterator) -> Iterator:
    """Sums of packed vectors by key, read as a stream; as many are held as there are keys."""
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _unpack(raw)
            sums[key] = sums[key] + own if key in sums else own
    if sums:
        packed = [_pack(v) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["i", "v"])


def summed_rows(rows: DataFrame, partial: Callable[[Iterator], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of a matrix that `partial` makes of a task's batches; None without any."""

    def one_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrix = partial(batches)
        if matrix is not None:
            keys = pa.array(range(len(matrix)), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.array([_pack(r) for r in matrix], pa.binary())], ["i", "v"])

    schema = "i int, v binary"
    parts = rows.mapInArrow(one_task, schema).repartition("i")
    found = sorted((r.i, _unpack(r.v)) for r in parts.mapInArrow(_add_up, schema).collect())
    return np.array([v for _, v in found]) if found else None


# Spectrum slicing -----------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        # both sides of the reflection, as a symmetric update of rank two
        p = 2 * a[k + 1 :, k + 1 :] @ x
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: the positive entries of D in LDL' of the matrix less the shift."""
    tiny = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0.0)))
    positive = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for d, e in zip(diagonal, np.concatenate(([0.0], off))):
        pivot = (d - shifts) - e * e / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        positive += pivot > 0
    return positive


def slices(diagonal: np.ndarray, off: np.ndarray, wanted: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """For the k-th largest eigenvalue, k up to `wanted`: bounds that hold it alone, or that are `width` apart.

    A slice is halved EXTRA times more once it is isolated, so that its middle is
    much nearer to its own eigenvalue than to the others, as a rule.
    """
    radius = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low = np.full(wanted, (diagonal - radius).min() - width)
    high = np.full(wanted, (diagonal + radius).max() + width)
    k = np.arange(1, wanted + 1)
    above_low, above_high = np.full(wanted, len(diagonal)), np.zeros(wanted, np.int64)
    extra = np.full(wanted, EXTRA)
    while True:
        alone = (above_low == k) & (above_high == k - 1)
        extra -= alone
        open_ = (~alone | (extra >= 0)) & (high - low > width)
        if not open_.any():
            return low, high
        middle = (low + high) / 2
        above = count_above(diagonal, off, middle)
        under = above >= k  # the k-th lies above the middle
        low, above_low = np.where(open_ & under, middle, low), np.where(open_ & under, above, above_low)
        high, above_high = np.where(open_ & ~under, middle, high), np.where(open_ & ~under, above, above_high)


def rayleigh(a: np.ndarray, low: float, high: float, found: np.ndarray, noise: float, rng) -> np.ndarray:
    """A unit eigenvector whose eigenvalue lies between the bounds, orthogonal to the rows of `found`."""

    def clean(v):
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    n = len(a)
    v, shift, eye = clean(rng.standard_normal(n)), (low + high) / 2, np.eye(n)
    best, least = v, np.inf
    for step in range(ITERATIONS):
        try:
            v = clean(np.linalg.solve(a - shift * eye, v))
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            shift += noise / 8
            continue
        av = a @ v
        value = v @ av
        error = np.linalg.norm(av - value * v)
        inside = low - noise <= value <= high + noise
        if inside and error < least:
            best, least = v, error
        elif least <= noise:  # rounding is reached
            return best
        # the middle of a slice is nearer to its own eigenvalue than to any other, so it leads back into the slice
        shift = value if inside and step else (low + high) / 2
    if least > noise:
        raise ArithmeticError("the iteration has not converged")
    return best


@dataclass
class Spectrum:
    """Leading eigenvalues, falling, with eigenvectors as rows; `trace` of the whole matrix."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float


def leading(a: np.ndarray, wanted: int) -> Spectrum:
    """Eigenvalues above rounding of a symmetric matrix without negative ones, at most `wanted`."""
    n, trace = len(a), float(np.trace(a))
    noise = 8 * n * EPS * max(trace, 0.0)
    none = Spectrum(np.zeros(0), np.zeros((0, n)), trace)
    if noise == 0:
        return none
    diagonal, off = tridiagonal(a)
    wanted = min(wanted, int(count_above(diagonal, off, np.array([noise]))[0]))
    if wanted == 0:
        return none
    low, high = slices(diagonal, off, wanted, noise)
    vectors, values = np.zeros((0, n)), []
    rng = np.random.default_rng(12)
    for k in range(wanted):
        v = rayleigh(a, low[k], high[k], vectors, noise, rng)
        vectors = np.vstack([vectors, v])
        values.append(v @ (a @ v))
    values = np.array(values)
    number = np.arange(1, wanted + 1)
    under, over = count_above(diagonal, off, values - 2 * noise), count_above(diagonal, off, values + 2 * noise)
    if (under < number).any() or (over >= number).any():
        raise ArithmeticError("an eigenvalue is not the one of its number")
    return Spectrum(values, vectors, trace)


# The operator ---------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit has found: rows, exact sums, and the components with their spectrum."""

    n: int
    sums: list[int]
    spectrum: Spectrum
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: whole numbers, of any size where a long is too small."""
        largest = self.n * (int(np.abs(x).max(initial=0)) + 1)
        exact = np.int64 if 2 * largest < LONG else object
        return x.astype(exact) * self.n - np.array(self.sums, exact)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        scaled = self.spectrum.vectors / np.sqrt(self.spectrum.values)[:, None]
        # not a matrix product, whose last digits depend on a row's place in its batch
        return np.einsum("ij,kj->ik", (deviations / self.n).astype(float), scaled)


def squares(deviations: np.ndarray) -> list:
    """The sum of squares of each row, exact; None beyond a long."""
    largest = int(np.abs(deviations).max(initial=0))
    if largest**2 * deviations.shape[1] <= LONG:
        return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = (deviations.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s <= LONG else None for s in sums]


def _products(x: np.ndarray, centre: np.ndarray, largest: int, wide: bool) -> np.ndarray:
    """Sum over rows of (x - centre)(x - centre)', exact; `largest` bounds the differences."""
    if wide:
        y = x.astype(object) - centre
        return y.T @ y
    y = (x - centre.astype(np.int64)).astype(float)
    # whole numbers are exact in doubles up to 2^53, so that many rows are summed at a time
    block = max(1, 2**53 // max(1, largest**2))
    total = np.zeros((x.shape[1],) * 2, np.int64)
    for at in range(0, len(y), block):
        part = y[at : at + block]
        total += (part.T @ part).astype(np.int64)
    return total


def fit(x_rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows as `grid` makes them; None if there are none."""
    n, least, most = x_rows.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return None

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                # in two halves, so that a long holds the sum of any batch
                own = (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                total = own if total is None else total + own
        return None if total is None else total[None, :]

    total = summed_rows(x_rows.select("x"), sums)[0]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], object)
    largest = max(abs(least - centre.max()), abs(most - centre.min()), 1)
    wide = largest**2 * n >= LONG or largest**2 > 2**53

    def moments(batches):
        out = None
        for batch in batches:
            if batch.num_rows:
                own = _products(_matrix(batch.column(0)), centre, largest, wide)
                out = own if out is None else out + own
        return out

    second = summed_rows(x_rows.select("x"), moments).astype(object)
    rest = np.array([s - n * c for s, c in zip(total, centre)], object)  # sums of the centred entries
    covariance = ((second * n - np.outer(rest, rest)) / (n * n)).astype(float)
    spectrum = leading(covariance, components)
    found = Whitening(n, [int(s) for s in total], spectrum, 0.0)
    if len(spectrum.values):

        def whitened_products(batches):
            out = None
            for batch in batches:
                if batch.num_rows:
                    w = found.project(found.deviations(_matrix(batch.column(0))))
                    own = w.T @ w
                    out = own if out is None else out + own
            return out

        # whitened entries have mean 0 by construction: they are made of differences from the mean
        seen = summed_rows(x_rows.select("x"), whitened_products) / n
        found.identity_error = float(np.abs(seen - np.eye(len(seen))).max())
    return found


WHITENED = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(x_rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per vector and component: vec_id and WHITENED."""
    id_type = x_rows.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if model is None or not len(model.spectrum.values):
            return
        k = len(model.spectrum.values)
        explained = model.spectrum.values / model.spectrum.trace
        step = max(1, OUTPUT_ROWS // k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                deviations = model.deviations(_matrix(part.column(1)))
                m = part.num_rows
                each = np.repeat(np.arange(m), k)
                deviation = pa.array(squares(deviations), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(model.project(deviations).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x_rows.select("vec_id", "x").mapInArrow(work, f"vec_id {id_type}, {WHITENED}")
