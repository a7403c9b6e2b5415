"""Embedding whitening: a compensated covariance over all vectors, and its leading components.

Entries become integers (floor(1024 * c) + 100000), whose sums are exact. Outer products of the centred integers are
accumulated in double-double: every product and every sum is split into what a double holds and the error it leaves
(error-free transformations), and tasks hand on both parts, which are merged by the same sums. The covariance is then
right to the last bit of a double whatever the number of rows, the order of tasks or the size of the mean.
Its eigenvectors are found on the driver, from d x d numbers, by reduction to a tridiagonal matrix and divide and
conquer (LAPACK's syevd, which numpy.linalg.eigh calls).

Defined results: vectors that are null or hold a null or non-finite entry take no part, nor do those with an entry of
2**40 or more (whose integer a double doesn't hold) or of another length than most vectors have (of equally frequent
lengths, the longer). Rows of a null id and repeated rows are rows like others. Without any vector left the result is
empty. A component without variance has no scale: its `whitened` is null, and it doesn't count in identity_error;
`explained` is null if nothing varies. A deviation beyond a long is null. Equal eigenvalues have any orthonormal basis
of their space."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, mapped

#: Partial results are merged in this many tasks before they reach the driver.
MERGERS = 32
#: Products that are held at once.
BLOCK = 1 << 17
#: An eigenvalue below this part of the largest one is rounding.
NOTHING = 1e-13


def usable(vector: Column, most: float = 2.0**40) -> Column:
    """Whether a vector has no null or non-finite entry, nor one of `most` or more."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= most)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have; 0 if there is none."""
    found = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return found["d"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of d entries as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024 * vectors).astype(np.int64) + 100_000


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum, and the error of the rounding."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of 26 bits that sum up to a."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def plus(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


class Products:
    """Sums of the products of all pairs of entries i <= j of double-double rows, in double-double."""

    def __init__(self, d: int):
        self.d, (self.i, self.j) = d, np.triu_indices(d)
        self.sum = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        step, (i, j) = max(1, BLOCK // len(self.i)), (self.i, self.j)
        for at in range(0, len(high), step):
            a, b = high[at : at + step], low[at : at + step]
            x, y = halves(a)
            p = a[:, i] * a[:, j]
            e = ((x[:, i] * x[:, j] - p) + x[:, i] * y[:, j] + y[:, i] * x[:, j]) + y[:, i] * y[:, j]
            e += a[:, i] * b[:, j] + b[:, i] * a[:, j]
            rows = two_sum(p, e)
            while len(rows[0]) > 1:  # pairwise, so that errors stay as small as the sums
                odd = tuple(r[-1:] for r in rows) if len(rows[0]) % 2 else None
                n = len(rows[0]) // 2
                rows = plus(tuple(r[:n] for r in rows), tuple(r[n : 2 * n] for r in rows))
                if odd:
                    rows = tuple(np.concatenate([r, o]) for r, o in zip(rows, odd, strict=True))
            self.sum = plus(self.sum, (rows[0][0], rows[1][0]))

    def square(self, n: int) -> np.ndarray:
        """The sums by n, as a symmetric matrix."""
        out = np.zeros((self.d, self.d))
        out[self.i, self.j] = (self.sum[0] + self.sum[1]) / n
        return out + np.triu(out, 1).T


PARTS = "part int, n long, high binary, low binary"


def part(n: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], ["part", "n", "high", "low"]
    )


def merged(parts: DataFrame, kind: type, add: Callable) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The sum of all tasks' parts (PARTS). They are merged in MERGERS tasks, which hold one part each, so that what
    reaches the driver is as small for a million tasks as for ten."""

    def total(rows: Iterator[tuple]) -> tuple | None:
        n, sums = 0, None
        for count, high, low in rows:
            given = np.frombuffer(high, kind), np.frombuffer(low, kind)
            n, sums = n + count, given if sums is None else add(sums, given)
        return None if sums is None else (n, *sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = total((r["n"], r["high"], r["low"]) for batch in batches for r in batch.to_pylist())
        if found:
            yield part(*found)

    return total((r["n"], bytes(r["high"]), bytes(r["low"])) for r in mapped(parts.repartition(MERGERS, "part"), run, PARTS).collect())


def exact(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def summed(vectors: DataFrame, vector: str, d: int) -> tuple[int, list[int]] | None:
    """Number of vectors and exact sums of their integers. High words and low words are summed apart."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = integers(matrix(batch.column(0), d))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield part(n, high, low)

    found = merged(mapped(vectors.select(vector), run, PARTS), np.int64, exact)
    return found and (found[0], [(int(a) << 32) + int(b) for a, b in zip(found[1], found[2], strict=True)])


@dataclass(frozen=True)
class Whitening:
    """What vectors are whitened by. mean: integer part, and the fraction as a double-double."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # their eigenvectors in columns
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integers less the mean, in double-double."""
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows projected on the components and scaled; nan where a component has no variance."""
        scale = np.sqrt(np.where(self.lively, self.values, np.nan))
        high, low = self.centred(x)
        return (high @ self.vectors + low @ self.vectors) / scale

    @property
    def lively(self) -> np.ndarray:
        return self.values > NOTHING * max(self.trace, 0.0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over entries of (n * x - S)**2, exact; None where it exceeds a long."""
        sums = np.array(self.sums, object)
        reach = max((max(abs(self.n * int(v) - s) for v in (lo, hi)) for lo, hi, s in zip(x.min(0), x.max(0), self.sums, strict=True)), default=0)
        if reach * reach * len(self.sums) < 2**63 and self.n * int(np.abs(x).max()) < 2**63:
            return (((self.n * x - sums.astype(np.int64)) ** 2).sum(1)).tolist()
        out = ((self.n * x.astype(object) - sums) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in out]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    whole = np.array([s // n for s in sums], np.int64)
    rest = [Fraction(s % n, n) for s in sums]
    high = np.array([float(r) for r in rest])
    low = np.array([float(r - Fraction(h)) for r, h in zip(rest, high, strict=True)])
    a, b = two_sum((x - whole).astype(np.float64), -high)
    return a, b - low


def covariance(vectors: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the vectors' integers."""
    d = len(sums)

    def run(batches):
        products, seen = Products(d), 0
        for batch in batches:
            x = integers(matrix(batch.column(0), d))
            products.add(*centred(x, n, sums))
            seen += len(x)
        if seen:
            yield part(seen, *products.sum)

    found, out = merged(mapped(vectors.select(vector), run, PARTS), np.float64, plus), Products(d)
    out.sum = found[1:]
    return out.square(n)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors (already selected by usable() and usual_length()); None if there are none."""
    d = usual_length(vectors, vector)
    found = summed(vectors, vector, d) if d else None
    if not found:
        return None
    n, sums = found
    v = covariance(vectors, vector, n, sums)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, tuple(sums), values[order], columns[:, order], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened column (centred by its own mean) less the identity."""
    live = np.flatnonzero(model.lively)
    if not len(live):
        return 0.0

    def over(mean: np.ndarray | None):
        def run(batches):
            products, sums, seen = Products(len(live)), (np.zeros(len(live)), np.zeros(len(live))), 0
            for batch in batches:
                z = matrix(batch.column(0), len(model.values))[:, live]
                seen += len(z)
                if mean is None:
                    sums = plus(sums, (z.sum(0), np.zeros(len(live))))
                else:
                    products.add(*two_sum(z, -mean))
            if seen:
                yield part(seen, *(sums if mean is None else products.sum))

        return merged(mapped(rows.select("whitened"), run, PARTS), np.float64, plus)

    n, high, low = over(None)
    out = Products(len(live))
    out.sum = over((high + low) / n)[1:]
    return float(np.abs(out.square(n) - np.eye(len(live))).max())


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and leading component."""
    kind = rows.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    chosen = rows.select(id, vector).where(usable(F.col(vector)))
    d = usual_length(chosen, vector)
    chosen = chosen.where(F.size(vector) == d)
    model = fit(chosen, vector, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column(1), d))
                z = model.whitened(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), flat], [id, "deviation", "whitened"])

    table = cut(mapped(chosen, run, f"`{id}` {kind}, deviation long, whitened array<double>"))
    off = identity_error(table, model)
    part_of = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    explained = F.get(F.array(*[F.lit(v).cast("double") for v in part_of]), F.col("k"))
    value = F.when(F.isnan("z"), None).otherwise(F.col("z"))
    return table.select(id, "deviation", F.posexplode("whitened").alias("k", "z")).select(
        id, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", value.alias("whitened"), explained.alias("explained"), F.lit(off).alias("identity_error")
    )
