"""Whitening of vectors: a distributed covariance, and its eigenvectors refined beyond double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import stored

SCALE, SHIFT = 64, 1_000_000  # of the integer vectors
COMPONENTS = 32
ROUNDS = 20  # refinement steps after which eigenvectors are taken as they are; about five are needed
APART = 8  # times the error of the estimates that eigenvalues must differ by to be corrected against each other
PARTED = 1e-7  # correction between clusters from which on each is solved by itself
LONG = (1 << 63) - 1

Wide = np.longdouble  # at least a double's precision; 64 bits of mantissa on common machines


def integer_vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id and x, the integer vector, of the rows that have one; see ``whitened``."""
    entry = F.col("v").cast("array<double>")
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 56)))
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    rows = stored(rows.select("vec_id", x.alias("x")), "whitening-vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (common["d"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's lists, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as integers of any size."""
    if len(x) and int(np.abs(x).max()) > LONG // len(x):
        x = x.astype(object)
    return x.sum(axis=0)


@dataclass
class Centre:
    """n vectors and the exact sums of their entries."""

    n: int
    sums: list[int]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: exact, as Python integers where a long is too short."""
        most = max(map(abs, self.sums), default=0)
        if len(x) and self.n * int(np.abs(x).max()) + most > LONG:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64) if most <= LONG else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squared offsets of each vector, exact; null if it is no long."""
        o = self.offsets(x)
        if o.dtype == object or (o.size and int(np.abs(o).max()) ** 2 * o.shape[1] > LONG):
            return [v if v <= LONG else None for v in (sum(int(c) ** 2 for c in row) for row in o)]
        return (o * o).sum(axis=1).tolist()


def centre(vectors: DataFrame) -> Centre:
    """One pass; each task gives one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            x = matrix(b.column("x"))
            n, part = n + len(x), exact_sum(x).astype(object)
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([int(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = vectors.select("x").mapInArrow(run, "i int, n long, s decimal(38, 0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28, 0)")).alias("s")).collect()
    rows.sort(key=lambda r: r["i"])  # one row a dimension
    return Centre(rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows])


def means(vectors: DataFrame, values: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Means of ``values`` over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = values(matrix(b.column("x"))).sum(axis=0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

    rows = vectors.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return np.array([r["s"] for r in sorted(rows, key=lambda r: r["i"])]) / max(n, 1)


def covariance(vectors: DataFrame, centred: Callable[[np.ndarray], np.ndarray], size: int, n: int) -> np.ndarray:
    """Products of the centred values over all vectors, divided by ``n``.

    A task adds up its own products and gives the upper triangle, a row of the matrix at a time. The matrix has the vectors'
    length squared entries, whatever the number of rows, so the driver can hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            z = centred(matrix(b.column("x")))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([total[i, i:].tolist() for i in range(size)], pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.select("x").mapInArrow(run, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["i"] + r["j"]] = out[r["i"] + r["j"], r["i"]] = r["v"] / n
    return out


def parts(a: np.ndarray, axis: int, inner: int) -> list[np.ndarray]:
    """Doubles that add up to ``a``, each with so few bits under the largest entry of its line that products of two are exact."""
    bits, out = (53 - max(inner - 1, 1).bit_length()) // 2, []
    for _ in range(-(-(np.finfo(Wide).nmant + 2) // bits)):  # as many as hold all of a
        most = np.abs(a).max(axis=axis, keepdims=True).astype(float)
        step = np.exp2(np.ceil(np.log2(np.where(most > 0, most, 1))) - bits).astype(Wide)
        out.append((np.rint(a / step) * step).astype(float))
        a = a - out[-1]
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b in ``Wide`` precision from exact double products, which the matrix routines make fast."""
    left, right = parts(a, 1, a.shape[1]), parts(b, 0, a.shape[1])
    out = np.zeros((a.shape[0], b.shape[1]), Wide)
    for i, j in sorted(((i, j) for i in range(len(left)) for j in range(len(left)) if i + j < len(left)), key=lambda p: -sum(p)):
        out += left[i] @ right[j]
    return out


def norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(float), 2)) if a.size else 0.0


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of the values, split where sorted neighbours lie further apart than ``gap``."""
    order = np.argsort(values)
    return np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)


def eigenvectors(a: np.ndarray, least: float | None = None) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix in ``Wide`` precision, in no order.

    A float32 solution is corrected by matrix products (Ogita and Aishima): with r = I - x'x and s = x'ax, the
    eigenvalues are estimated as s_ii / (1 - r_ii), and x (I + e) is nearer, where e_ij = (s_ij + l_j r_ij) /
    (l_j - l_i). Values nearer to each other than the error of s cannot be told apart that way: there e_ij =
    r_ij / 2 only straightens the columns, and the small matrix q'aq of a cluster's columns q, with its
    mean value taken off so that its gaps become large, is solved by itself in the same way, unless it is
    diagonal but for entries up to ``least``, by default a 2 ** 58th of the largest of ``a``.
    """
    size = len(a)
    a = a.astype(Wide)
    a = (a + a.T) / 2  # products of three matrices are symmetric but for rounding
    if size < 2:
        return np.eye(size, dtype=Wide)
    a = a - np.eye(size, dtype=Wide) * (np.trace(a) / size)
    spread = np.abs(a).max()
    least = float(spread) / (1 << 58) if least is None else least
    if np.abs(a - np.diag(np.diag(a))).max() <= least:
        return np.eye(size, dtype=Wide)
    a, least = a / spread, float(least / spread)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    fine, unit, length = False, np.eye(size, dtype=Wide), norm(a)
    last = np.inf
    for _ in range(ROUNDS):
        r, s = unit - product(x.T, x), product(x.T, product(a, x))
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * (norm(s - np.diag(np.diag(s))) + length * norm(r))
        groups = clusters(value.astype(float), APART * error)
        if len(groups) == 1 and not fine:  # float32 tells none apart
            x, fine = np.linalg.eigh(a.astype(float))[1].astype(Wide), True
            continue
        if len(groups) == 1:  # nor does a double: to its precision all values are equal
            return straight(x)
        label = np.empty(size, int)
        for k, g in enumerate(groups):
            label[g] = k
        apart = label[:, None] != label[None, :]
        distance = value[None, :] - value[:, None]
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, distance, 1), r / 2)
        x = x + product(x, e)
        now = float(np.abs(e).max())
        for g in groups:
            if len(g) > 1 and now < PARTED:  # the cluster's columns span what they should
                q = x[:, g]
                x[:, g] = product(q, eigenvectors(product(q.T, product(a, q)), least))
        if now < 4 * np.finfo(Wide).eps * size or (now >= last and now < 1e-17 * size):
            break
        last = now
    return straight(straight(x))


def straight(q: np.ndarray) -> np.ndarray:
    """Columns made orthonormal that nearly are."""
    return q + product(q, np.eye(q.shape[1], dtype=Wide) - product(q.T, q)) / 2


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and the unit eigenvectors as columns, in double precision."""
    x = eigenvectors(v)
    value = np.einsum("ij,ij->j", x, product(v.astype(Wide), x)) if len(v) else np.zeros(0, Wide)
    order = np.argsort(-value, kind="stable")
    return value[order].astype(float), x[:, order].astype(float)


def whitened(rows: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per vector and component up to ``most``: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes the integer floor(64 c) + 1,000,000. Vectors that are null or have a null, infinite or undefined
    entry, or none at all, are left out, as are entries from 2 ** 56 on, which no long holds, and vectors that have not
    the length that most have (the longer of two as frequent). The others all shape the result: their
    covariance is summed over the tasks, its eigenvectors are found on the driver (length squared numbers),
    and each row is projected where it lies. Repeated rows and null ids count each. A deviation beyond a long is
    null. A component along which the vectors do not differ (an eigenvalue of zero to double precision) has null
    whitened values and no part in identity_error. Without vectors there are no rows; other columns are ignored.
    """
    vectors = integer_vectors(rows, key, column)
    mid = centre(vectors)
    size = len(mid.sums)
    v = covariance(vectors, mid.centred, size, mid.n) if size else np.zeros((0, 0))
    value, x = components(v)
    k = min(most, size)
    value, x = value[:k], x[:, :k]
    real = value > (value[0] if k else 0) * size * np.finfo(float).eps
    weights = np.where(real, x / np.sqrt(np.where(real, value, 1)), 0.0)
    explained = (value / np.trace(v) if k and np.trace(v) > 0 else np.zeros(k)).tolist()

    def project(x: np.ndarray) -> np.ndarray:
        return mid.centred(x) @ weights

    average = means(vectors, project, mid.n)
    error = 0.0
    if real.any():
        white = covariance(vectors, lambda x: project(x) - average, k, mid.n)
        error = float(np.abs(white - np.eye(k))[np.ix_(real, real)].max())
    n = mid.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            m = len(x)
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array([d for d in mid.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(project(x).ravel(), mask=np.tile(~real, m)),
                pa.array(explained * m, pa.float64()),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))
