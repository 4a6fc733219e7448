"""A stored vector index: trained cells whose rows are files of their own, and product-quantised residuals.

create() trains on a bounded sample: centroids of cells by k-means over unit vectors, and for each stretch of a
vector's numbers a codebook of what is left of it after its cell's centroid.  Every row is then given its cell and its
codes and written under ``path``, parted by group of neighbouring cells and sorted by cell, with the trained tables
beside it.  search() reads the groups and cells that its queries probe and no others: candidates are scored by
codes (a table look-up a stretch), the best are scored again by their whole vectors, and k of them stay.  An exact
search takes the last of these scores as a bound and looks again into every cell that could hold a row above it.

At scale: the sample and the trained tables are bounded by Settings, whatever the number of rows; encoding is one pass
without a shuffle before the write; a cell that holds a large part of all rows is dealt to parts of PART_ROWS rows.
A search shuffles codes and ids of probed cells, and whole vectors of candidates alone.

Rows without a vector are not in the index.  Vectors of another length than the first, a column of a reserved name, and
null or repeated ids' rows: the first two are errors on creation; ids are kept as they are, and a repeated id may be
found once for each of its rows.  An empty table makes an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.vectors import MOST_SENT, packed

#: Names that the index gives its own columns.
RESERVED = ("cell", "group", "part", "codes", "unit")
#: Rows of one cell in one part, and queries that one task scores at once.
PART_ROWS, QUERY_BLOCK = 20_000, 500


@dataclass(frozen=True)
class Settings:
    """How an index is trained."""

    #: Rows a cell, about, and the most cells; groups of neighbouring cells, each a folder.
    rows_a_cell: int = 4
    most_cells: int = 4096
    groups: int = 32
    #: Stretches of a vector and the most codes of each.
    stretches: int = 16
    codes: int = 256
    #: Rows and bytes of the training sample, at most.
    sample: int = 50_000
    sample_bytes: int = 64 << 20
    rounds: int = 12
    seed: int = 5


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Of every row the place of the closest centre."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[a : a + block] @ centres.T - half).argmax(1) for a in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres; one that loses all its rows begins again at a row far from its own."""
    k = min(k, len(x))
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        held = count > 0
        centres[held] = total[held] / count[held, None]
        if not held.all():
            far = np.argsort(((x - centres[own]) ** 2).sum(1))[::-1][: (~held).sum()]
            centres[~held] = x[far]
    return centres


@dataclass
class Trained:
    """The tables of an index: unit centroids by cell, each cell's group, ends of stretches, and codebooks (stretch, code, number)."""

    width: int
    centroids: np.ndarray
    groups: np.ndarray
    ends: np.ndarray
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(x, self.centroids)
        left = x - self.centroids[cells]
        return cells, np.stack([nearest(left[:, a:b], book) for a, b, book in zip(self.ends, self.ends[1:], self.books)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells closest to each query, the closest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries and coded rows of a cell."""
        total = np.repeat((q @ self.centroids[cell])[:, None], len(codes), 1)
        for k, (a, b, book) in enumerate(zip(self.ends, self.ends[1:], self.books)):
            total += (q[:, a:b] @ book.T)[:, codes[:, k]]
        return total


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def train(x: np.ndarray, n: int, s: Settings) -> Trained:
    """Tables from sampled vectors ``x`` of a table of ``n`` rows."""
    rng = np.random.default_rng(s.seed)
    x = unit(x)
    width = x.shape[1]
    centroids = unit(k_means(x, max(1, min(s.most_cells, n // s.rows_a_cell)), s.rounds, rng))
    groups = nearest(centroids, k_means(centroids, min(s.groups, len(centroids)), s.rounds, rng))
    order = np.argsort(groups, kind="stable")
    centroids, groups = centroids[order], groups[order]
    left = x - centroids[nearest(x, centroids)]
    ends = np.linspace(0, width, min(s.stretches, width) + 1).astype(int)
    books = [k_means(np.ascontiguousarray(left[:, a:b]), s.codes, s.rounds, rng) for a, b in zip(ends, ends[1:])]
    return Trained(width, centroids, groups, ends, books)


def vectors_in(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def create(chunks: DataFrame, path: str, id: str = "chunk_id", vector: str = "embedding", settings: Settings = Settings()) -> None:
    """Write an index of ``chunks`` to ``path``; columns other than id and vector are kept and can be filtered by."""
    if taken := [c for c in chunks.columns if c in RESERVED]:
        raise ValueError(f"reserved names: {', '.join(taken)}")
    spark, s = chunks.sparkSession, settings
    rows = chunks.where(F.col(vector).isNotNull())
    n, least, most = rows.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most or most == 0:
        raise ValueError(f"vectors of {least} to {most} numbers")
    if not n:
        spark.createDataFrame([], chunks.schema).write.parquet(f"{path}/empty")
        return
    bound = max(1, min(s.sample, s.sample_bytes // (8 * most)))
    # Those with the least hashes: a sample of at most ``bound`` rows, the same however rows are partitioned.
    keyed = rows.select(F.col(vector).alias("v"), F.xxhash64(F.col(vector), F.col(id).cast("string")).alias("h"))
    sample = np.array([r["v"] for r in keyed.orderBy("h").limit(bound).collect()], np.float64)
    t = train(sample, n, s)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", cell int, group int, codes binary, unit array<float>"
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(vectors_in(batch.column(at), t.width))
                cells, codes = t.encode(x)
                whole = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * t.width, pa.int32()), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(t.groups[cells], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), whole], names=[*kinds, "cell", "group", "codes", "unit"])

    coded = rows.mapInArrow(run, schema)
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row a cell
    parts = np.array([-(-sizes.get(c, 0) // PART_ROWS) or 1 for c in range(len(t.centroids))])
    deals = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1) if (parts > 1).any() else F.lit(1)
    dealt = coded.withColumn("part", F.pmod(F.xxhash64(F.col(id).cast("string"), "codes"), deals).cast("int"))
    dealt.repartition("group", "part").sortWithinPartitions("group", "cell").write.partitionBy("group").parquet(f"{path}/rows")
    tables = [("centroids", t.centroids), ("groups", t.groups), ("ends", t.ends), ("parts", parts), *((f"book{k:04}", b) for k, b in enumerate(t.books))]
    spark.createDataFrame([(name, list(map(int, a.shape)), a.astype(np.float64).tobytes()) for name, a in tables], "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/tables")


def opened(spark: SparkSession, path: str) -> tuple[Trained, np.ndarray]:
    """The trained tables of an index (bounded by its settings), and how many parts each cell has."""
    held = {r["name"]: np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/tables").collect()}
    centroids = held["centroids"]
    return Trained(centroids.shape[1], centroids, held["groups"].astype(int), held["ends"].astype(int), [held[k] for k in sorted(held) if k.startswith("book")]), held["parts"].astype(int)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tables")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def checked(asked: DataFrame, found: DataFrame, rows: DataFrame, t: Trained, k: int) -> DataFrame:
    """query, id and score of every row that may be among the k most similar of a query, and of few others.

    asked: query and vector; found: query, id and score, as an index gave them; rows: id, cell and vector.  The score of a
    query's k-th found row is a bound, and by the triangle's inequality the angles of a query and of a row that passes it to
    any centroid differ by no more than the bound's angle: of a cell whose rows are all farther off no product is taken.
    Queries meet rows in blocks, as in dense_top_k(); of equal scores the k lowest ids of a block go on.
    """
    bounds = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("bound"))
    own = asked.join(bounds, "query", "left").select(F.struct("query", F.coalesce("bound", F.lit(-1.0)).alias("bound")).alias("asked"), "vector")
    n = own.count()
    wanted = packed(own.repartition(max(1, -(-n // QUERY_BLOCK))), "asked", [], "vector").select(F.col("ids").alias("asked"), F.col("matrix").alias("q_matrix"))
    if n * t.width * 8 <= MOST_SENT:
        wanted = F.broadcast(wanted)
    pairs = packed(rows, "id", ["cell"], "vector").drop("width").crossJoin(wanted)
    kind, id_kind = asked.schema["query"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, matrix, asked, q_matrix = (batch.column(c).slice(i, 1) for c in range(5))
                x, q = (np.frombuffer(m[0].as_buffer(), np.float64).reshape(-1, t.width) for m in (matrix, q_matrix))
                ids, asked = ids.flatten(), asked.flatten()
                names, bound = asked.field("query"), asked.field("bound").to_numpy()
                cells = keys.flatten().field("cell").to_numpy()
                order = np.lexsort((pa.compute.rank(ids).to_numpy(), cells))
                x, cells = x[order], cells[order]
                angle = lambda cosine: np.arccos(np.clip(cosine, -1.0, 1.0))
                lean = angle((x * t.centroids[cells]).sum(1))
                starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                off = angle(q @ t.centroids[cells[starts]].T)
                # Angles of nearly equal vectors are known to about 1e-8.
                reach = angle(bound - 1.1e-6)[:, None] + 1e-7
                open_ = (off >= np.minimum.reduceat(lean, starts) - reach) & (off <= np.maximum.reduceat(lean, starts) + reach)
                for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)])):
                    if len(asking := np.flatnonzero(open_[:, c])):
                        scores = q[asking] @ x[a:b].T
                        at, row = np.nonzero(scores >= bound[asking, None] - 1.1e-6)
                        kept = pd.DataFrame({"q": asking[at], "row": row + a, "score": scores[at, row]})
                        kept = kept[kept.groupby(["q", "score"], sort=False).cumcount() < k]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(kept["q"].to_numpy())), ids.take(pa.array(order[kept["row"].to_numpy()])), pa.array(kept["score"].to_numpy())], names=["query", "id", "score"])

    return pairs.mapInArrow(run, f"query {kind}, id {id_kind}, score double").withColumn("score", F.round("score", 6))


def search(queries: DataFrame, path: str, k: int, probes: float = 0.18, again: int = 8, query_id: str = "query_id", id: str = "chunk_id", vector: str = "embedding", where: str | None = None, exact: bool = False) -> DataFrame:
    """query_id, id, score and rank of about the k most similar rows of every query.

    ``probes``: cells to look into, as a part of all; ``again`` times k candidates are scored by their whole vectors.
    ``where``: a condition on the kept columns, applied to the rows as they are read.  ``exact``: what was found is checked
    against all other cells (checked()), and the k most similar rows are given; equal scores are ranked by id.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).alias("vector"))
    kind = asked.schema["query"].dataType.simpleString()
    if not exists(spark, path):
        rows = spark.read.parquet(f"{path}/empty")
        return asked.join(rows.select(F.col(id), F.lit(0.0).alias("score"), F.lit(1).alias("rank")), F.lit(True)).select(F.col("query").alias(query_id), id, "score", "rank")
    t, parts = opened(spark, path)
    n_probes = max(1, int(np.ceil(probes * len(t.centroids))))
    keep = again * k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if set(pa.compute.list_value_length(batch.column(1)).to_pylist()) != {t.width}:
                raise ValueError(f"the index holds vectors of {t.width} numbers")
            q = unit(vectors_in(batch.column(1), t.width))
            cells = t.probed(q, n_probes)
            rows = np.repeat(np.arange(len(q)), cells.shape[1])
            cells = cells.ravel()
            times = parts[cells]  # a query goes to each part of a cell
            rows, cells = np.repeat(rows, times), np.repeat(cells, times)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * t.width, pa.int32()), pa.array(q.ravel()))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), whole.take(at), pa.array(cells, pa.int32()), pa.array(part, pa.int32())], names=["query", "q", "cell", "part"])

    probed = asked.mapInArrow(probe, f"query {kind}, q array<double>, cell int, part int")
    cells = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most all cells
    rows = spark.read.parquet(f"{path}/rows")
    read = rows.where(F.col("group").isin([int(g) for g in np.unique(t.groups[cells])]) & F.col("cell").isin(cells))
    if where:
        read = read.where(where)
    id_kind = rows.schema[id].dataType.simpleString()

    def scored(key: tuple, own: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(coded):
            codes = np.frombuffer(b"".join(coded["codes"]), np.uint8).reshape(len(coded), -1)
            ids = coded["id"].to_numpy()
            for a in range(0, len(own), QUERY_BLOCK):
                block = own.iloc[a : a + QUERY_BLOCK]
                scores = t.scores(np.stack(block["q"].to_numpy()), key[0], codes)
                m = min(keep, scores.shape[1])
                best = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                found.append(pd.DataFrame({"query": np.repeat(block["query"].to_numpy(), m), "id": ids[best.ravel()], "cell": key[0], "part": key[1], "near": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "id": [], "cell": [], "part": [], "near": []})

    near = probed.groupBy("cell", "part").cogroup(read.select(F.col(id).alias("id"), "codes", "cell", "part").groupBy("cell", "part")).applyInPandas(scored, f"query {kind}, id {id_kind}, cell int, part int, near double")
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))).where(F.col("at") <= keep)
    vectors = asked.select("query", F.col("vector").cast("array<double>").alias("q"))
    met = best.select("query", "id", "cell", "part").join(read.select(F.col(id).alias("id"), "cell", "part", F.col(vector).cast("array<double>").alias("v")), ["cell", "part", "id"]).join(vectors, "query")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v"))
    rated = met.select("query", "id", F.round(F.when(length == 0, 0.0).otherwise(dot("q", "v") / F.when(length == 0, 1.0).otherwise(length)), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    if exact:
        first = rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        every = spark.read.parquet(f"{path}/rows")
        rated = checked(asked, first, (every.where(where) if where else every).select(F.col(id).alias("id"), "cell", F.col(vector).alias("vector")), t, k)
    return rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias(query_id), F.col("id").alias(id), "score", "rank")


def scored_part(queries: DataFrame, path: str, probes: float = 0.18, vector: str = "embedding") -> float:
    """Pairs of queries and rows that a search scores by codes, as a part of all pairs."""
    spark = queries.sparkSession
    t, _ = opened(spark, path)
    sizes = np.zeros(len(t.centroids))
    for r in spark.read.parquet(f"{path}/rows").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    n_probes = max(1, int(np.ceil(probes * len(t.centroids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen = sizes[t.probed(unit(vectors_in(batch.column(0), t.width)), n_probes)].sum()
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([batch.num_rows * float(sizes.sum())])], names=["seen", "all"])

    seen, total = queries.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "seen double, all double").agg(F.sum("seen"), F.sum("all")).first()
    return seen / total if total else 0.0
