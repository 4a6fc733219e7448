"""Vector similarity, exact and filtered top-k search, hashed search, and order-bound clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that one matrix holds; a larger batch is searched in as many blocks.
QUERY_BLOCK = 500
#: Bytes of queries that are sent to every task; more meet the chunks block by block in a shuffled product.
MOST_SENT = 64 << 20
#: Bytes of scores that a worker holds at once; a block's queries are taken in as many steps.
SCORE_BYTES = 4 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length; vectors of different sizes are an error."""
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(same / F.when(length == 0, 1.0).otherwise(length))


def filters(spec: dict) -> Column:
    """A predicate from {field: value} or {field: {"$eq" | "$ne" | "$gt" | "$gte" | "$lt" | "$lte" | "$in": value}}."""
    made = F.lit(True)
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v)}
    for name, value in spec.items():
        for op, operand in (value if isinstance(value, dict) else {"$eq": value}).items():
            if op not in ops:
                raise ValueError(f"unknown filter {op!r}")
            made &= ops[op](F.col(name), operand)
    return made


def packed(rows: DataFrame, id: str, by: list[str], vector: str) -> DataFrame:
    """Blocks of vectors: ids, keys (a struct of ``by`` for each), and the unit vectors as one matrix (rows, width, float64 bytes)."""
    own = rows.select(F.col(id).alias("id"), F.struct(F.lit(0).alias("_"), *by).alias("key"), F.col(vector).alias("vector")).where("vector is not null")
    schema = T.StructType([T.StructField("ids", T.ArrayType(own.schema["id"].dataType)), T.StructField("keys", T.ArrayType(own.schema["key"].dataType)), T.StructField("width", T.IntegerType()), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            if (sizes != sizes[0]).any():
                raise ValueError("vectors of different sizes")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
            values /= np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, batch.column(0)), pa.ListArray.from_arrays(ends, batch.column(1)), pa.array([int(sizes[0])], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=schema.names)

    return own.mapInArrow(run, schema)


def codes_of(keys: pa.StructArray, by: list[str]) -> np.ndarray:
    """A number for each row's values of ``by``, from 0; null is a value."""
    codes = np.zeros(len(keys), np.int64)
    for name in by:
        own = keys.field(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
    return codes


def best_in_blocks(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str, by: list[str], vector: str, buckets: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The k best chunks of every query and value of ``by``: query_id, by, chunk_id, score, rank.

    ``buckets``: gives each of a matrix's rows its buckets, one of each table (rows, tables); then only rows that share a bucket count.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("vector"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    wanted = packed(asked.repartition(max(1, -(-size["n"] // QUERY_BLOCK))), "query", [], "vector").select(F.col("ids").alias("queries"), F.col("width").alias("q_width"), F.col("matrix").alias("q_matrix"))
    if size["n"] * max(size["width"] or 0, 1) * 8 <= MOST_SENT:
        wanted = F.broadcast(wanted)
    held = packed(chunks, chunk_id, by, vector)
    pairs = held.crossJoin(wanted)
    kind = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("key", held.schema["keys"].dataType.elementType), T.StructField("id", held.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

    limit = SCORE_BYTES

    def best(scores: np.ndarray, groups: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for rows in groups:
            part = scores[:, rows] if len(groups) > 1 else scores
            # What rounding could lift over the cut goes on too; of equal scores the k lowest ids.
            least = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - 1.1e-6 if part.shape[1] > k else np.full(len(part), -np.inf)
            q, c = np.nonzero((part >= least[:, None]) & (part > -np.inf))
            found = pd.DataFrame({"q": q, "c": rows[c], "score": part[q, c]})
            yield found[found.groupby(["q", "score"], sort=False).cumcount() < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, width, matrix, names, q_width, q_matrix = (batch.column(c).slice(i, 1) for c in range(7))
                if width[0] != q_width[0]:
                    raise ValueError("vectors of different sizes")
                n = width[0].as_py()
                own, asked = (np.frombuffer(m[0].as_buffer(), np.float64).reshape(-1, n) for m in (matrix, q_matrix))
                ids, keys, names = ids.flatten(), keys.flatten(), names.flatten()
                order = pc.sort_indices(ids).to_numpy()
                own, codes = own[order], codes_of(keys, by)[order]
                groups = [np.flatnonzero(codes == code) for code in range(codes.max() + 1)]
                if buckets:
                    held, met = np.ascontiguousarray(buckets(own).T), buckets(asked).T
                step = max(1, limit // (8 * len(own)))
                for at in range(0, len(asked), step):
                    scores = asked[at : at + step] @ own.T
                    if buckets:
                        shared = np.zeros(scores.shape, bool)
                        for h, m in zip(held, met[:, at : at + step]):
                            shared |= m[:, None] == h
                        scores[~shared] = -np.inf
                    found = pd.concat(best(scores, groups))
                    picked = pa.array(order[found["c"].to_numpy()])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(found["q"].to_numpy() + at)), keys.take(picked), ids.take(picked), pa.array(found["score"].to_numpy())], names=kind.names)

    found = pairs.mapInArrow(run, kind)
    order = Window.partitionBy("query", *[f"key.{b}" for b in by]).orderBy(F.desc("score"), "id")
    ranked = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), *[F.col(f"key.{b}").alias(b) for b in by], F.col("id").alias(chunk_id), "score", "rank")


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", by: list[str] | None = None, vector: str = "embedding", where: dict | None = None) -> DataFrame:
    """Exact top-k chunks by cosine for every query, within each value of ``by`` (such as the namespace).

    Columns: query_id, by, chunk_id, score, rank.  Chunks are read once and packed to blocks, queries to blocks of
    QUERY_BLOCK; blocks meet as one matrix product each (in steps of SCORE_BYTES), of which the top-k are kept, so what is
    shuffled is k rows a query, group and block.  Neither passes the driver.  Equal scores are ranked by chunk id; rows
    without a vector are in no list.  A worker holds what travels from the JVM at once (the session's
    spark.sql.execution.arrow.maxBytesPerBatch, or one pair of blocks), a step's scores and what it keeps of them.
    """
    return best_in_blocks(queries, chunks.where(filters(where)) if where else chunks, k, query_id, chunk_id, by or [], vector)


def hashed_top_k(queries: DataFrame, chunks: DataFrame, k: int, tables: int = 32, bits: int = 5, seed: int = 3, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Approximate top-k: chunks that share a random-hyperplane bucket with the query in any table; of repeated ids one counts.

    Recall grows with ``tables`` and falls with ``bits``.  The defaults reach 0.98 of the five nearest on the driver's 2,000
    vectors, where 0.63 of all pairs share a bucket: far too many to join, so blocks meet as in dense_top_k(), buckets are
    compared a table at a time within a step's scores, and no pair is a row.
    """
    kind = np.uint8 if bits <= 8 else np.int64

    def buckets(own: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(seed).normal(size=(tables * bits, own.shape[1]))
        return ((own @ planes.T > 0).reshape(len(own), tables, bits) @ (1 << np.arange(bits))).astype(kind)

    return best_in_blocks(queries.dropDuplicates([query_id]), chunks.dropDuplicates([chunk_id]), k, query_id, chunk_id, [], vector, buckets)


def sequential_clusters(df: DataFrame, doc: str, order: str, vector: str = "embedding", threshold: float = 0.45, recent: int = 5) -> DataFrame:
    """Append ``cluster``: in the order of a document each row joins the most similar of the last ``recent`` clusters, or begins one.

    A cluster's centre is the running mean of its rows; the first of equals wins.  Documents stream through their task
    in order, and of a document no more than the last ``recent`` centres are held, so it may be of any length.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("cluster", T.IntegerType())])
    at_doc, at_vector = df.columns.index(doc), df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no document's key
        centres: list[np.ndarray] = []
        sizes: list[int] = []
        begun = 0
        for batch in batches:
            labels = []
            for key, v in zip(batch.column(at_doc).to_pylist(), batch.column(at_vector)):
                if key != current:
                    current, centres, sizes, begun = key, [], [], 0
                v = np.asarray(v.values, np.float64)
                best, score = -1, -1.0
                for c, centre in enumerate(centres):
                    length = float(np.linalg.norm(centre) * np.linalg.norm(v))
                    s = float(centre @ v) / length if length > 1e-9 else 0.0
                    if s > score:
                        best, score = c, s
                if best >= 0 and score >= threshold:
                    sizes[best] += 1
                    centres[best] = centres[best] + (v - centres[best]) / sizes[best]
                    labels.append(begun - len(centres) + best)
                else:
                    centres, sizes, begun = [*centres, v][-recent:], [*sizes, 1][-recent:], begun + 1
                    labels.append(begun - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int32())], names=schema.names)

    return df.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(run, schema)
