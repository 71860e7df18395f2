"""Whitening of embeddings: compensated covariance in double-double, tridiagonal divide-and-conquer eigen-solve."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

COMPONENTS = 32
#: entries become floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: rows of one exact product, and bits of a slice: 2 * BITS + log2(ROWS) is 53
ROWS, BITS = 512, 22
#: partial matrices that one task adds up
FAN = 32
#: entries from here on (as scaled) are not told apart by doubles
LARGEST = 2.0**52


def integers(vectors: DataFrame, embedding: str = "embedding", name: str = "x") -> DataFrame:
    """``vectors`` with ``name``, the embedding's entries as longs floor(64 c) + 1,000,000. Rows go whose vector is null, empty, holds
    null or non-finite entries, or entries beyond 2^52 / 64, for which there is no such number in double precision."""
    e = F.col(embedding).cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn(name, F.transform(e, lambda c: F.floor(c * SCALE) + SHIFT))


def by_length(column: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, matrix)`` of the vectors of each length in a batch."""
    sizes = column.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.stack(column.iloc[at].to_numpy())


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and its exact error (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def slices(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``x`` as three matrices whose columns are multiples of one power of two by integers of at most BITS bits, and what is left:
    an error-free splitting, so that products of slices over up to ROWS rows are exact in doubles."""
    _, exponent = np.frexp(np.abs(x).max(axis=0, initial=0))
    out = []
    for k in range(1, 4):
        unit = np.ldexp(1.0, exponent - k * BITS)
        part = np.rint(x / unit) * unit
        out.append(part)
        x = x - part
    return out, x


class DoubleDouble:
    """A matrix as an unevaluated sum ``high + low``, to which products are added."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low

    @classmethod
    def zero(cls, *shape: int) -> DoubleDouble:
        return cls(np.zeros(shape), np.zeros(shape))

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> DoubleDouble:
        """Adds ``high + low``, keeping the rounding error of the high parts' sum."""
        self.high, e = two_sum(self.high, high)
        self.low = self.low + (e + low)
        return self

    def add_product(self, a: np.ndarray, b: np.ndarray, a_low: np.ndarray | None = None, b_low: np.ndarray | None = None) -> DoubleDouble:
        """Adds ``(a + a_low)' (b + b_low)``: the slices' products are exact, and so are their errors when added."""
        for s in range(0, len(a), ROWS):
            x, y = a[s : s + ROWS], b[s : s + ROWS]
            left, rest_x = slices(x)
            right, rest_y = (left, rest_x) if a is b else slices(y)
            rest_x = rest_x + (0 if a_low is None else a_low[s : s + ROWS])
            rest_y = rest_y + (0 if b_low is None else b_low[s : s + ROWS])
            for p in left:
                for q in right:
                    self.add(p.T @ q)
            self.low = self.low + (x.T @ rest_y + rest_x.T @ y)
        return self

    def settled(self) -> DoubleDouble:
        """The low part at most half a unit in the last place of the high one."""
        return DoubleDouble(*two_sum(self.high, self.low))


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``x - S / n`` as high and low parts: whole parts are taken off exactly, fractions are divided in double-double."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = [s % n for s in sums]
    q = np.array([p / n for p in part])  # correctly rounded
    lack = np.array([float(Fraction(p, n) - Fraction(v)) for p, v in zip(part, q)])
    high, e = two_sum((x - whole).astype(float), -q)
    return high, e - lack


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where it is no long."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([s % n for s in sums], dtype=object)
    z = x - whole
    if float(np.abs(z).max(initial=0) + 1) * n * np.sqrt(x.shape[1]) < 2**31:
        return ((z * n - part.astype(np.int64)) ** 2).sum(axis=1).tolist()
    found = ((z.astype(object) * n - part) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def eigen(v: DoubleDouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; largest entry positive) of a symmetric matrix.

    LAPACK's symmetric driver behind ``eigh`` (tridiagonal form, then divide and conquer) gives vectors for the high part. Two steps of
    refinement (Ogita and Aishima 2018) with residuals in double-double take in the low part; eigenvalues are Rayleigh
    quotients in double-double.
    """
    v = v.settled()
    _, q = np.linalg.eigh((v.high + v.high.T) / 2)

    def quotients(q: np.ndarray) -> tuple[DoubleDouble, np.ndarray]:
        # the matrix is symmetric, so its columns serve as its rows
        t = DoubleDouble.zero(*q.shape).add_product(v.high, q, v.low).settled()
        return DoubleDouble.zero(*q.shape).add_product(q, t.high, None, t.low).settled(), DoubleDouble.zero(*q.shape).add_product(q, q).add(-np.eye(len(q))).settled().high

    for _ in range(2):
        s, r = quotients(q)
        r = -r  # I - Q'Q
        values = s.high.diagonal() / (1 - r.diagonal())
        off = s.high - np.diag(s.high.diagonal())
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 2 * (np.linalg.norm(off) + np.abs(values).max(initial=0) * np.linalg.norm(r))
        step = np.where(apart, (s.high + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        np.fill_diagonal(step, r.diagonal() / 2)
        q = q + q @ step
    q = q / np.linalg.norm(q, axis=0)
    s, r = quotients(q)
    values = s.high.diagonal() / (1 + r.diagonal())
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    return values, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1, 1)


MATRIX = "dims int, high binary, low binary"


def _frame(found: dict[int, DoubleDouble]) -> pd.DataFrame:
    return pd.DataFrame({"dims": np.array(list(found), dtype=np.int32), "high": [m.high.tobytes() for m in found.values()], "low": [m.low.tobytes() for m in found.values()]})


def _merged(partials: DataFrame, count: int) -> DataFrame:
    """One row per ``dims``: matrices of up to FAN tasks are added in one, high and low parts, then those of up to FAN such
    tasks, and so on, so that no task and not the driver gets more than FAN of each at a time."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, DoubleDouble] = {}
        for batch in batches:
            for r in batch.itertuples():
                high, low = (np.frombuffer(x) for x in (r.high, r.low))
                found[r.dims] = found[r.dims].add(high, low) if r.dims in found else DoubleDouble(high, low)
        yield _frame(found)

    while True:
        count = -(-count // FAN)
        partials = partials.repartition(max(1, count)).mapInPandas(merge, MATRIX)
        if count <= 1:
            return partials


def _products(rows: DataFrame, made: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray | None]], name: str) -> DataFrame:
    """Sum of outer products of what ``made`` makes of rows of integers, one matrix per length."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, DoubleDouble] = {}
        for batch in batches:
            for d, _, x in by_length(batch.x):
                high, low = made(d, x)
                k = high.shape[1]
                found.setdefault(d, DoubleDouble.zero(k, k)).add_product(high, high, low, low)
        yield _frame({d: m.settled() for d, m in found.items()})

    partials = cut(rows.select("x").mapInPandas(add, MATRIX), name)
    return _merged(partials, partials.count())


class Whitening:
    """What is fitted on vectors of one length: ``n``, exact ``sums``, ``vectors`` (dims by components), their eigenvalues
    ``values``, ``trace`` and ``identity_error``. A component whose eigenvalue is within rounding of zero has no whitened values."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.identity_error: float | None = None

    def solved(self, vectors: np.ndarray, values: np.ndarray, trace: float) -> None:
        self.vectors, self.values, self.trace = vectors, values, trace
        self.real = values > len(self.sums) * np.finfo(float).eps * max(values.max(initial=0), 0)
        self.by = np.sqrt(np.where(self.real, values, 1))

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.n, self.sums)
        return (high @ self.vectors + low @ self.vectors) / self.by

    def explained(self) -> list[float | None]:
        return [float(max(v, 0) / self.trace) if self.trace > 0 else None for v in self.values]


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vector, fitted on all vectors of it: exact sums, centred outer products in
    double-double, then the eigen-solve in one task; three reads of the vectors, nothing shuffled but a matrix per task.

    The driver gets ``components`` vectors of each length. No vectors: no fits.
    """
    rows = integers(vectors, embedding).select("x")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, _, x in by_length(batch.x):
                n, s = found.get(d, (0, [0] * d))
                high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
                found[d] = n + len(x), [a + (h << 26) + l for a, h, l in zip(s, high, low)]
        for d, (n, s) in found.items():
            yield pd.DataFrame({"dims": d, "at": range(d), "n": n, "s": [Decimal(v) for v in s]})

    sums = rows.mapInPandas(total, "dims int, at int, n long, s decimal(38,0)").groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dims", "at").collect():  # as many rows as dimensions
        got.setdefault(r.dims, (r.n, []))[1].append(int(r.s))
    fits = {d: Whitening(n, s) for d, (n, s) in got.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                v = DoubleDouble(*(np.frombuffer(x).reshape(r.dims, r.dims) for x in (r.high, r.low)))
                values, q = eigen(v)
                k = min(components, r.dims)
                yield pd.DataFrame({"dims": [r.dims], "vectors": [np.ascontiguousarray(q[:, :k]).tobytes()], "value": [values[:k]], "trace": [v.high.trace() + v.low.trace()]})

    if fits:
        solved = _products(rows, lambda d, x: centred(x, fits[d].n, fits[d].sums), "whitening-products").mapInPandas(solve, "dims int, vectors binary, value array<double>, trace double")
        for r in solved.collect():
            f = fits[r.dims]
            f.solved(np.frombuffer(r.vectors).reshape(r.dims, -1), np.array(r.value) / f.n, r.trace / f.n)
        # the whitened vectors' own covariance, with a column of ones for their means
        seen = _products(rows, lambda d, x: (np.column_stack([fits[d].project(x), np.ones(len(x))]), None), "whitening-identity")
        for r in seen.collect():
            f = fits[r.dims]
            k = len(f.values) + 1
            m = (np.frombuffer(r.high) + np.frombuffer(r.low)).reshape(k, k) / f.n
            off = np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(k - 1))[np.ix_(f.real, f.real)]
            f.identity_error = float(off.max()) if off.size else None
    return fits


def whiten(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, str]:
    """``vectors`` whose embedding is fit for it, with all their columns and one more, whose name is returned: a struct of ``n`` (vectors
    fitted on), ``deviation``, ``values`` (whitened, one per component; null where the eigenvalue is zero), ``explained`` (share of the
    trace) and ``identity_error``.

    Rows whose vector is null, empty, not finite or too large for doubles go (see ``integers``). Repeated rows are rows of their own, ties of
    eigenvalues take any basis, the same for all rows. Vectors of each length are a fit list of their own. A single vector
    or equal ones have eigenvalues of zero: null values. A deviation that is no long is null.
    """
    fits, x = fit(vectors, embedding, components), fresh(vectors, "x")
    out = fresh(vectors, "whitened")
    if out.lower() == x.lower():
        out += "_"

    @F.pandas_udf("n long, deviation long, values array<double>, explained array<double>, identity_error double")
    def applied(column: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame(index=range(len(column)), columns=["n", "deviation", "values", "explained", "identity_error"], dtype=object)
        for d, at, m in by_length(column):
            f = fits[d]
            w = f.project(m).astype(object)
            w[:, ~f.real] = None
            shares = f.explained()
            got.iloc[at, 0], got.iloc[at, 1], got.iloc[at, 4] = f.n, deviations(m, f.n, f.sums), f.identity_error
            for k, values in zip(at, w):
                got.iat[k, 2], got.iat[k, 3] = values.tolist(), shares
        return got.astype({"n": "Int64", "deviation": "Int64", "identity_error": "Float64"})

    return integers(vectors, embedding, x).withColumn(out, applied(x)).drop(x), out


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    got, w = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    at, value = fresh(got, "at"), fresh(got, "value")
    rows = got.select("vec_id", F.col(w), F.posexplode(f"{w}.values").alias(at, value))
    return rows.select("vec_id", (F.col(at) + 1).cast("int").alias("component"), f"{w}.n", f"{w}.deviation", F.col(value).alias("whitened"), F.get(f"{w}.explained", F.col(at)).alias("explained"), f"{w}.identity_error")
