"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of one key that go to one task in spread(): so many, or this part of all rows, so that keys of more rows are few.
LEAST_HOT, HOT_PART = 1000, 10_000
#: Rows that a plain join may hold, whatever their keys: a task can't have more.
FEW = 10_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = _U(0xD6E8FEB86659FD93)
_WORD_BASE_INV = _U(pow(int(_WORD_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` (or of SparkContext.setCheckpointDir), which all executors share.

    Where none is set, a local session (one process, as in tests) gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the operators keep tables in a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ragloom-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    Lost executors cannot lose these rows. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, table: DataFrame, key: list[str], size: str | None = None, least: int | None = None) -> DataFrame:
    """rows.join(table, key), where ``table``, a kept one, has each key once and ``rows`` may have a key very often.

    Rows of such a key (more than ``least`` or LEAST_HOT of them, and more than a HOT_PARTth of all rows) are dealt
    over tasks, and its one row of ``table`` is sent to each.  ``size``: the column of ``table`` that says how many rows
    have the key; without it they are counted.  At most HOT_PART keys are broadcast.  A table of few rows (FEW) is
    simply joined.
    """
    if size:
        sizes = table.select(*key, F.col(size).alias("__size"))
        total = sizes.agg(F.sum("__size")).first()[0] or 0
    else:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("__size"))
        total = rows.count()
    if total <= FEW:
        return rows.join(table, key)
    least = max(least or LEAST_HOT, total // HOT_PART)
    hot = sizes.where(F.col("__size") > least).select(*key, F.ceil(F.col("__size") / least).cast("int").alias("__deals"))
    deals = F.coalesce("__deals", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__deal", F.pmod(F.xxhash64(*rows.columns), deals).cast("int")).drop("__deals")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("__deals")
    return dealt.join(copies, [*key, "__deal"]).drop("__deal")


def narrow(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker holds Python objects and results of few rows at once.

    What travels from the JVM at once is bounded in bytes by the session (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, jobs send at most so many rows to a worker at once: of long texts or sets the buffers of both sides stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def steps(sizes: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows of these sizes into runs of about ``limit``; no row is split."""
    if not len(sizes):
        return
    at = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = at[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(at, done + limit, side="right")))
        yield first, last
        first = last


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(n, 2 * STEP_BYTES)
        known = np.full(size, base, np.uint64)
        known[:1] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * STEP_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """Position-independent 64-bit hashes of values[start:end], from one prefix sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row of utf8(): starts, ends, first word of each row, hashes."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64)
    inside = ~_SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    if fold_case:
        data = _LOWER[data]
    hashes = span_hashes(data.astype(np.uint64) + _U(1), starts, ends, _BASE, _BASE_INV)
    return starts, ends, np.searchsorted(starts, offsets), hashes


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(hashes, starts, starts + length, _WORD_BASE, _WORD_BASE_INV)


def ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds values[ends[i]:ends[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))
