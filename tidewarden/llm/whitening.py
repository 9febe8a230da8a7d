"""Embedding whitening: float32 eigenvectors of the distributed covariance, refined in higher precision.

Entries become integers, so that sums and products over all rows are exact whatever the order in which
partitions are merged. The driver holds one matrix of the dimension: its float32 eigenvectors are corrected by the
matrix-multiplication iteration of Ogita and Aishima (2018), and eigenvalues that it can't tell
apart (2019) by a solve of their own inside the subspace. Vectors never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import settle

#: The precision of the corrections: 64 bits of mantissa or more wherever the platform has them.
HIGH = np.longdouble
#: Entries are cut into signed limbs of so many bits; products of limbs are exact in float64 over a block of rows.
LIMB, BLOCK, LARGEST = 20, 2048, 1 << 59
#: A number travels as so many digits of so many bits, the last one signed.
DIGITS, DIGIT = 4, 40
SUMS = "line int, salt int, digits array<long>"


def grid(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as a double, as long; null for a vector that is null or has an entry that is null, not finite or too large for it."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) >= LARGEST))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), scaled)


# -- exact sums over all rows ----------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    out = []
    while y.any():
        low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def product(y: np.ndarray) -> np.ndarray:
    """y.T @ y in exact integers."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    for k in range(0, len(y), BLOCK):
        parts = _limbs(y[k : k + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                out = out + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return out


def _digits(row: list[int]) -> list[int]:
    return [int(v) >> (DIGIT * k) if k == DIGITS - 1 else (int(v) >> (DIGIT * k)) & ((1 << DIGIT) - 1) for k in range(DIGITS) for v in row]


def _exact_sum(table: DataFrame, partial, d: int) -> dict[int, list[int]]:
    """line -> exact sums of the rows that partial(matrices) makes for each partition: combined twice, then one row a line to the driver.

    A partition sends as many rows of d numbers as the result has lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lines = [_digits(row) for row in partial(_matrix(b.column(0), d) for b in batches if b.num_rows)]
        salts = [TaskContext.get().partitionId() % 64] * len(lines)
        yield pa.record_batch({"line": pa.array(range(len(lines)), pa.int32()), "salt": pa.array(salts, pa.int32()), "digits": pa.array(lines, pa.list_(pa.int64()))})

    def merge(t: pa.Table) -> pa.Table:
        total = _matrix(t.column("digits"), DIGITS * d).reshape(-1, DIGITS, d).sum(0)
        for k in range(DIGITS - 1):
            total[k + 1] += total[k] >> DIGIT
            total[k] &= (1 << DIGIT) - 1
        return pa.table({"line": t.column("line")[:1], "salt": t.column("salt")[:1], "digits": pa.array([total.ravel()], pa.list_(pa.int64()))})

    salted = table.mapInArrow(run, SUMS).groupBy("line", "salt").applyInArrow(merge, SUMS)
    return {r.line: [sum(r.digits[k * d + j] << (DIGIT * k) for k in range(DIGITS)) for j in range(d)] for r in salted.groupBy("line").applyInArrow(merge, SUMS).collect()}


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of each dimension of a table of one array<long> column."""

    def partial(parts):
        total = np.zeros(d, object)
        for x in parts:
            total = total + (x >> 31).sum(0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)
        return [total]

    return _exact_sum(fit, partial, d).get(0, [0] * d)


def covariance(fit: DataFrame, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The exact covariance (divisor n): rows are centred at the rounded mean before they are multiplied, the mean's fraction is taken off exactly."""
    d = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    shift = np.array(centre, np.int64)

    def partial(parts):
        total = np.zeros((d, d), object)
        for x in parts:
            total = total + product(x - shift)
        return list(total)

    lines = _exact_sum(fit, partial, d)
    rest = [Fraction(s, n) - c for s, c in zip(sums, centre, strict=True)]
    return [[Fraction(lines[i][j], n) - rest[i] * rest[j] for j in range(d)] for i in range(d)]


# -- eigenvectors on the driver: one matrix of the dimension ---------------------------------------


def high(matrix: list[list[Fraction]]) -> np.ndarray:
    """Exact fractions as numbers of the higher precision."""
    first = np.array([[float(v) for v in row] for row in matrix], np.float64)
    rest = np.array([[float(v - Fraction(float(v))) for v in row] for row in matrix], np.float64)
    return first.astype(HIGH) + rest.astype(HIGH)


def _clusters(values: np.ndarray, delta) -> list[list[int]]:
    """Runs of ascending eigenvalues that stand no further apart than delta."""
    out = [[0]]
    for k in range(1, len(values)):
        if values[k] - values[k - 1] <= delta:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues rising, eigenvectors) of a symmetric a in the higher precision, from approximate eigenvectors x.

    One round costs a dozen matrix products. Pairs of eigenvalues nearer to each other than the error of the
    round can't be corrected one by one: their subspace alone is corrected, and once it stands (the next rounds
    change it little) a rotates inside it by a solve of the small matrix with the mean eigenvalue taken off, where the gaps are large again.
    """
    d = len(a)
    eye, size = np.eye(d, dtype=HIGH), np.abs(a).sum(0).max()
    if not size:
        return np.zeros(d, HIGH), eye
    floor, x = 4 * d * np.finfo(HIGH).eps, x.astype(HIGH)
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        if np.abs(r).max() <= floor and np.abs(off).max() <= floor * size:
            break
        delta = 8 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        near = np.eye(d, dtype=bool)
        groups = [g for g in _clusters(values, delta) if len(g) > 1]
        for g in groups:
            near[np.ix_(g, g)] = True
        gap = np.where(near, 1, values[None, :] - values[:, None])
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / gap)
        # inside the subspace of a cluster, solve with its mean taken off
        for g in groups:
            v = x[:, g] @ (1.5 * np.eye(len(g), dtype=HIGH) - 0.5 * (x[:, g].T @ x[:, g]))
            mean = values[g].mean()
            small = v.T @ (a @ v - mean * v)
            small = (small + small.T) / 2
            scale = np.abs(small).max()
            if scale > floor * size:
                x[:, g] = v @ np.linalg.eigh((small / scale).astype(np.float64))[1].astype(HIGH)
        for _ in range(3):  # steps between near eigenvalues are large enough for their square to matter
            x = x @ (1.5 * eye - 0.5 * (x.T @ x))
    x = x / np.sqrt((x * x).sum(0))
    values = np.array([v @ (a @ v) for v in x.T], HIGH)
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order]


@dataclass(frozen=True)
class Whitening:
    """n rows of the fit, their exact sums and trace, and the leading components: eigenvalues falling, unit eigenvectors as rows."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    rank: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integers: (x - mean) on each component over the root of its eigenvalue; nan without variance."""
        off = np.stack([(x[:, j].astype(object) * self.n - s).astype(np.float64) for j, s in enumerate(self.sums)], 1) / self.n if self._wide(x) else (x * self.n - np.array(self.sums, np.int64)) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.arange(len(self.values)) < self.rank, off @ self.vectors.T / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exact; none where it is more than a long holds."""
        if self._wide(x, squared=True):
            sums = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
            return [v if v < 1 << 63 else None for v in sums]
        return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()

    def _wide(self, x: np.ndarray, squared: bool = False) -> bool:
        most = float(max(np.abs(x).max(initial=0), 1)) * self.n + max(map(abs, self.sums), default=0)
        return (most * most * len(self.sums) if squared else most) >= 2.0**62


def fit_whitening(fit: DataFrame, n: int, d: int, components: int) -> Whitening:
    """Whitening of a table of n rows of one array<long> column of d entries."""
    sums = column_sums(fit, d)
    exact = covariance(fit, n, sums)
    a = high(exact)
    a = (a + a.T) / 2
    scale = np.abs(a).max() or HIGH(1)
    start = np.linalg.eigh((a / scale).astype(np.float32))[1]
    values, vectors = refine(a / scale, start)
    values, vectors = values[::-1][:components] * scale, vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    rank = int((values > np.finfo(np.float64).eps * d * scale).sum())
    return Whitening(n, sums, float(sum((exact[i][i] for i in range(d)), Fraction(0))), values.astype(np.float64), vectors.T.astype(np.float64).copy(), rank)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit's covariance minus the identity, measured over all rows of the fit."""
    k, d = model.rank, len(model.sums)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = model.project(_matrix(b.column(0), d))[:, :k]
                first += w.sum(0)
                second += w.T @ w
        for i in range(k):
            for j in range(k):
                yield pa.record_batch({"i": [i], "j": [j], "second": [second[i, j]], "first": [first[i]]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("second", pa.float64()), ("first", pa.float64())]))

    rows = fit.mapInArrow(run, "i int, j int, second double, first double").groupBy("i", "j").agg(F.sum("second").alias("second"), F.sum("first").alias("first")).collect()
    mean = {r.i: r.first / model.n for r in rows}
    return max(abs(r.second / model.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row with a usable vector and each component.

    Rows whose vector is null or has an entry that is null, not finite or at least 2**59 / scale are left out, and so
    are vectors of another length than most have (of equally frequent lengths, the longer) and empty ones. The fit takes each distinct
    vector of integers once, however often it is repeated; every remaining row is whitened, null and repeated ids included. A component
    without variance (fewer distinct vectors or dimensions than components) has null whitened and, if no dimension varies, null
    explained and identity_error; there are at most as many components as dimensions. deviation is null where it exceeds a long. An empty table gives an empty
    result; other columns are not read, whatever their names.

    The distinct vectors are one shuffle, combined before it, so that copies of one vector meet as one
    row a task. Each pass over them sends one matrix of the dimension a partition, merged in two levels.
    """
    id_type = dict(table.dtypes)[id_col]
    rows = table.select(F.col(id_col).alias("vec_id"), grid(F.col(vector_col), scale).alias("x")).where(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("d")).count().collect()
    d = max(((r["count"], r.d) for r in lengths), default=(0, 0))[1]
    if not d:
        return table.sparkSession.createDataFrame([], f"vec_id {id_type}, {OUT}")
    rows = rows.where(F.size("x") == d)
    fit, n = settle(rows.select("x").distinct(), each=20_000)
    model = fit_whitening(fit, n, d, min(components, d))
    error = identity_error(fit, model)
    explained = [float(v) / model.trace if model.trace else None for v in model.values]
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _matrix(b.column(1), d), b.num_rows
            again = np.repeat(np.arange(m), k)
            w = model.project(x).ravel()
            yield pa.record_batch({
                "vec_id": b.column(0).take(pa.array(again)), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), "n": pa.array(np.full(m * k, model.n), pa.int64()),
                "deviation": pa.array(model.deviation(x), pa.int64()).take(pa.array(again)), "whitened": pa.array(w, pa.float64(), mask=np.isnan(w)),
                "explained": pa.array(explained * m, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64()),
            })

    return rows.mapInArrow(run, f"vec_id {id_type}, {OUT}")
