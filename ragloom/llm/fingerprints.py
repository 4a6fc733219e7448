"""Document fingerprints: quartile bucket digests.

Byte triplets of a sliding window are hashed into 256 buckets and counted.  A bucket is
encoded by the quartile of the counts that it falls in, two bits each; before them stand
a byte of checksum, one for the length (logarithmic) and one for the ratios of the
quartiles.  Two digests differ by a bounded score: buckets by how far their quartiles lie
apart, and a little for checksum, length and ratios.  likeness() is 1 less the score's share of its bound; for
texts so short that their filled buckets could not reach the bound, of what they could.

Text null or empty: all counts are zero, and the digest tells the length alone; a text of
one or two bytes counts as a triplet that zeros fill up.  Rows of one id stand in the order
of their texts, so repeated rows follow one another; a null id comes first.  An empty table
gives no rows, and other columns are not looked at (fingerprints() keeps them and replaces
one of the name that it appends).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import written

BUCKETS = 256
#: A bucket's share of the score by how many quartiles lie between two codes.
STEP_SCORE = np.array([0, 1, 2, 6], np.uint8)
#: Most that length and ratios add, and the score that counts as no likeness at all.
MOST_LENGTH, MOST_RATIO, BOUND = 36, 12, 400
#: Bytes before the buckets.
HEAD = 3
#: Places in the window that a triplet reads.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_SALTS = np.array([374761393, 668265263, 1274126177], np.uint32)


def counts(data: np.ndarray) -> np.ndarray:
    """How many triplets fall into each bucket; every kind of triplet is counted at all places where it fits."""
    total = np.zeros(BUCKETS, np.int64)
    if not len(data):
        return total
    wide = np.zeros(max(len(data), 3), np.uint32)
    wide[: len(data)] = data
    for k, (a, b, c) in enumerate(TRIPLETS):
        n = max(len(wide) - c, 0)
        h = wide[a : a + n] * _FACTORS[0]
        h += wide[b : b + n] * _FACTORS[1]
        h += wide[c : c + n] * _FACTORS[2]
        h += _SALTS[k]
        h ^= h >> np.uint32(15)
        h *= _FACTORS[1]
        h ^= h >> np.uint32(13)
        h *= _FACTORS[2]
        total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: str) -> bytes:
    data = np.frombuffer(text.encode(), np.uint8)
    own = counts(data)
    q1, q2, q3 = np.sort(own)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (own > q1).astype(np.uint8) + (own > q2) + (own > q3)
    packed = codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)
    length = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    return bytes([zlib.crc32(data) & 255, length, ratios]) + packed.sum(1).astype(np.uint8).tobytes()


_PAIR = np.zeros((256, 256), np.uint8)
_CODES = np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3
for _k in range(4):
    _PAIR += STEP_SCORE[np.abs(_CODES[:, None, _k] - _CODES[None, :, _k])]


def difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    body = int(_PAIR[x[HEAD:], y[HEAD:]].sum())
    length = abs(int(x[1]) - int(y[1]))
    ratio = abs(int(x[2] >> 4) - int(y[2] >> 4)) + abs(int(x[2] & 15) - int(y[2] & 15))
    return body + int(x[0] != y[0]) + min(MOST_LENGTH, length) + min(MOST_RATIO, ratio)


_FILLED = STEP_SCORE.astype(np.int64)[_CODES].sum(1)


def likeness(a: bytes, b: bytes) -> float:
    filled = int(_FILLED[np.frombuffer(a, np.uint8)[HEAD:]].sum() + _FILLED[np.frombuffer(b, np.uint8)[HEAD:]].sum())
    return max(0.0, 1.0 - difference(a, b) / min(BOUND, filled or BOUND))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the digest of every text, as hexadecimal text."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t.as_py() or "").hex() for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def row(text: str, own: bytes, following: str, after: bytes) -> tuple[int, str, str, str, float, float]:
    changed = edited(text, following)
    new = digest(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, after)


FIELDS = [("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64())]


def with_successor(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and the next one in the order of ids (after the last: the first).

    Rows are dealt to ranges of ids and sorted there, so the next row mostly follows at
    once.  The last row of a range waits for the first of the next range; these pairs, as
    many as there are ranges, are joined afterwards.
    """
    base = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = base.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    fields = [T.StructField("id", base.schema["id"].dataType), *(T.StructField(n, t) for n, t, _ in FIELDS)]
    kinds = [T.StructField("part", T.IntegerType()), T.StructField("end", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([*fields, *kinds])

    def batch_of(ids: pa.Array, rows: list, part: int, end: str | None, texts: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
        n = len(ids)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, (_, _, k) in zip(columns, FIELDS)), pa.array([part] * n, pa.int32()), pa.array([end] * n, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[pa.Array, str, bytes] | None = None
        for batch in batches:
            ids, rows, at = [], [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                own = digest(t)
                if held is None:
                    yield batch_of(batch.column(0).slice(i, 1), [(len(t), None, own.hex(), None, None, None)], part, "head", [t])
                else:
                    ids.append(held[0])
                    rows.append(row(held[1], held[2], t, own))
                held = (batch.column(0).slice(i, 1), t, own)
                at += len(t)
            if ids:
                yield batch_of(pa.concat_arrays(ids), rows, part, None, [None] * len(rows))
        if held is not None:
            yield batch_of(held[0], [(len(held[1]), None, held[2].hex(), None, None, None)], part, "tail", [held[1]])

    found = written(ranged.mapInArrow(run, schema), "fingerprints")
    heads = found.where("end = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("after"))
    order = Window.orderBy("next")  # over one row a range
    ranges = heads.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(order), F.first("next").over(order)).alias("next"))
    tails = found.where("end = 'tail'").select("id", "part", "text", "fingerprint").join(ranges, "part").join(heads, "next").select("id", "text", "fingerprint", "following", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t, bytes.fromhex(f), n, bytes.fromhex(a)) for t, f, n, a in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(columns, FIELDS))], names=["id", *(n for n, _, _ in FIELDS)])

    whole = found.where("end is null").select("id", *(n for n, _, _ in FIELDS)).union(tails.mapInArrow(finish, T.StructType(fields)))
    return whole.withColumnRenamed("id", id)
