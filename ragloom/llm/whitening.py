"""Embedding whitening by TSQR and a one-sided Jacobi SVD.

A row's entries become integers floor(scale * c) + shift; rows whose vector is null, or holds a null or an entry that
is not finite, are dropped.  The fit list is each distinct vector of integers once.  Its centred rows are compressed to
one triangle R: each task folds its blocks into a triangle, and triangles are folded FOLD at a time by further tasks,
until one is left (a square of the dimension, whatever the number of rows).  Plane rotations make R's columns
orthogonal; the rotations, gathered, are the components, and the columns' lengths the standard deviations times sqrt(n),
with small ones as accurate, relatively, as large ones.  Columns are sorted by falling length in between, and rotations
of disjoint pairs are done at once.

Sums are of integers, so exact and alike however rows are partitioned.  A row is centred as
(n*x - S) / n from integers.
The driver holds sums by dimension, one triangle and one square; n, rows and distinct vectors stay with the tasks.
Repeated vectors are counted out by a grouping that combines them before its shuffle, so a vector that a third of all
rows share does no harm.

Vectors of another length than the commonest (of equally common ones the longest) and empty vectors are dropped as well.
A component of no variance (a deviation under RANK_TOLERANCE of the largest, as with fewer distinct vectors than
dimensions) has no whitened value and no rows.  Null and repeated ids are rows like others, a table without usable
vectors gives no rows, and other columns are not looked at.  A squared deviation beyond a long, which needs entries or
counts in the millions, is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.support import written

#: Rows that a task factors at once, and triangles that one task folds.
BLOCK, FOLD = 4096, 16
#: Entries beyond this are no numbers that a long holds exactly once scaled and summed; they count as this.
LIMIT = 1 << 52
RANK_TOLERANCE = 1e-12
#: Sweeps of rotations end when no pair of columns has a cosine above this, or after so many.
COSINE, SWEEPS = 1e-15, 60


@dataclass(frozen=True)
class Settings:
    components: int = 16
    scale: int = 64
    shift: int = 1_000_000


@dataclass(frozen=True)
class Means:
    """Rows of the fit list, and by dimension the whole part of the mean and what it leaves of the sum."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly."""
        d = x - self.whole
        if d.size and int(np.abs(d).max()) + 1 >= (1 << 62) // self.n:
            d = d.astype(object)
        return d * self.n - self.left

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x - S/n."""
        return self.centred(x).astype(np.float64) / self.n


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: rows of the fit list, means, components (columns), deviations, total variance."""

    means: Means
    components: np.ndarray
    deviations: np.ndarray
    trace: float
    identity_error: float


def integers(vector: Column, s: Settings) -> Column:
    """The vector as longs, or null where it is dropped."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * s.scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long") + s.shift
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.transform(vector, entry))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, square."""
    r = np.linalg.qr(rows, mode="r")
    if len(r) < rows.shape[1]:
        r = np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])
    return r


def rounds(m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns in rounds of disjoint pairs: one column stays, the others go round."""
    seats = list(range(m + m % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if max(a, b) < m]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of ``r``, by falling values."""
    a, v = r.astype(np.float64).copy(), np.eye(r.shape[1])
    turns = rounds(r.shape[1])
    for _ in range(SWEEPS):
        largest = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
        a, v, worst = a[:, largest], v[:, largest], 0.0
        for i, k in turns:
            x, y = a[:, i], a[:, k]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx) * np.sqrt(yy)
            cosine = np.abs(xy) / np.where(size > 0, size, 1.0)
            go = np.flatnonzero((size > 0) & (cosine > COSINE))
            if not len(go):
                continue
            worst = max(worst, float(cosine[go].max()))
            i, k, zeta = i[go], k[go], (yy[go] - xx[go]) / (2 * xy[go])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            for m in (a, v):
                left, right = m[:, i].copy(), m[:, k].copy()
                m[:, i], m[:, k] = c * left - c * t * right, c * t * left + c * right
        if not worst:
            break
    values = np.linalg.norm(a, axis=0)
    order = np.argsort(-values, kind="stable")
    return v[:, order], values[order]


def means(fit_rows: DataFrame) -> Means | None:
    """Sums in two halves, of a task's rows first, so that no long overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), len(batch.column(0)[0]))
                n, high, low = n + len(x), high + (x >> 20).sum(0), low + (x & (1 << 20) - 1).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    summed = fit_rows.select("x").mapInArrow(partial, "at int, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = sorted(summed.collect())  # one row a dimension
    if not rows:
        return None
    n, sums = rows[0]["n"], [(r["high"] << 20) + r["low"] for r in rows]
    return Means(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]))


def factor(fit_rows: DataFrame, m: Means) -> np.ndarray:
    """R of the centred rows (column ``x``), folded by tasks until one triangle is left."""
    width = len(m.whole)

    def fold(batches: Iterator[pa.RecordBatch], of=None) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = of(batch.column(0)) if of else batch.column(0).flatten().to_numpy().reshape(-1, width)
            for at in range(0, len(rows), BLOCK):
                block = rows[at : at + BLOCK]
                r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    left = written(fit_rows.select("x").mapInArrow(lambda b: fold(b, lambda c: m.offsets(matrix(c, width))), "r array<double>"), "whitening-r")
    while (count := left.count()) > 1:
        # Kept ones are read again by files, FOLD or more to a task, so folding needs no shuffle.
        left = written(left.coalesce(-(-count // FOLD)).mapInArrow(fold, "r array<double>"), "whitening-r")
    return np.array(left.first()[0]).reshape(width, width)


def moments(fit_rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, centred before multiplying."""
    width, k = w.components.shape

    def partial(batches: Iterator[pa.RecordBatch], mean=None) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = whitened(matrix(batch.column(0).slice(at, BLOCK), width), w)
                total = total + (z.sum(0) if mean is None else (z - mean).T @ (z - mean))
        if np.ndim(total):
            flat = np.ravel(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    def summed(mean) -> np.ndarray:
        rows = fit_rows.select("x").mapInArrow(lambda b: partial(b, mean), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        return np.array([r["value"] for r in sorted(rows.collect(), key=lambda r: r["at"])]) / w.means.n

    return float(np.abs(summed(summed(None)).reshape(k, k) - np.eye(k)).max())


def whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    return w.means.offsets(x) @ w.components / w.deviations


def fit(rows: DataFrame, settings: Settings = Settings()) -> Whitening | None:
    """The whitening of ``rows`` (column ``x``, integers of one length, some rows repeated); None without rows or variance."""
    fit_rows = written(rows.select("x").distinct(), "whitening-fit")
    m = means(fit_rows)
    if m is None:
        return None
    r = factor(fit_rows, m)
    vectors, values = jacobi(r)
    kept = int((values[: settings.components] > RANK_TOLERANCE * values[0]).sum())
    if not kept:
        return None
    w = Whitening(m, vectors[:, :kept], values[:kept] / np.sqrt(m.n), float((r * r).sum()) / m.n, 0.0)
    return replace(w, identity_error=moments(fit_rows, w))


def usable(df: DataFrame, vec_id: str, vector: str, s: Settings) -> DataFrame:
    """vec_id and x, the vector as integers, of the rows that remain."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), integers(F.col(f"`{vector}`"), s).alias("x")).where(F.col("x").isNotNull())
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == lengths["n"]) if lengths else rows


def squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exactly: as integers where they fit, digit by digit where they may not."""
    rough = (d.astype(np.float64) ** 2).sum(1)
    exact = [None] * len(d) if d.dtype == object else (d * d).sum(1).tolist()
    for i in np.flatnonzero((rough > 2.0**62) | (d.dtype == object)):
        total = sum(int(v) ** 2 for v in d[i])
        exact[i] = total if total < 1 << 63 else None
    return exact


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every remaining row and component."""
    rows = usable(df, vec_id, vector, settings)
    w = fit(rows, settings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("vec_id", vec_id)
    n, width, k = w.means.n, len(w.means.whole), len(w.deviations)
    explained = w.deviations**2 / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix(batch.column(1), width)
                m = len(x)
                deviation = pa.array(squares(w.means.centred(x)), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each), pa.array(whitened(x, w).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error))],
                    names=names,
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("vec_id", vec_id)
