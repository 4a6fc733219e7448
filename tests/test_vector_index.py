"""The stored index against exact search: recall, pairs scored, files read, and what creation refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import vector_index, vectors

DATA = "/root/testdata/sf0.1"


def made(spark, n=1500, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.5 * rng.normal(size=d)], f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, source string")


def recall(found, exact, k):
    best = {}
    for r in exact.collect():
        best.setdefault(r["query_id"], set()).add(r["chunk_id"])
    hits = sum(r["chunk_id"] in best[r["query_id"]] for r in found.collect())
    return hits / (k * len(best))


def test_recall_with_a_fifth_of_the_pairs(spark, tmp_path):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    path = str(tmp_path / "given")
    vector_index.create(given, path)
    queries = given.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert vector_index.scored_part(queries, path) < 0.2
    found = vector_index.search(queries, path, 5)
    assert found.columns == ["query_id", "chunk_id", "score", "rank"]
    assert recall(found, vectors.dense_top_k(queries, given, 5), 5) >= 0.9
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in vectors.dense_top_k(queries, given, 5).collect()}
    assert all(abs(exact.get((r["query_id"], r["chunk_id"]), r["score"]) - r["score"]) < 2e-6 for r in found.collect())


def test_few_cells_are_read_for_one_question(spark, tmp_path):
    chunks, path = made(spark), str(tmp_path / "index")
    vector_index.create(chunks, path, settings=vector_index.Settings(rows_a_cell=50, groups=8))
    one = chunks.where("chunk_id = 7").select(F.lit(1).alias("query_id"), "embedding")
    found = vector_index.search(one, path, 5, probes=0.05)
    assert found.first()["chunk_id"] == 7
    scans = [x for x in found._jdf.queryExecution().toString().split("\n") if "FileScan" in x and "codes" in x]
    assert scans and all("PartitionFilters: [" in x and "group" in x.partition("PartitionFilters: [")[2] for x in scans)
    assert recall(found.where("rank <= 5"), vectors.dense_top_k(one, chunks, 5), 5) >= 0.8


def test_filters_hot_cells_and_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 40)
    same = spark.range(200).select((F.col("id") + 5000).alias("chunk_id"), F.array(*[F.lit(1.0)] * 24).cast("array<float>").alias("embedding"), F.lit("hot").alias("source"))
    chunks, path = made(spark, 300).unionByName(same), str(tmp_path / "index")
    vector_index.create(chunks, path)
    _, parts = vector_index.opened(spark, path)
    assert parts.max() == 5
    asked = spark.createDataFrame([(1, [1.0] * 24), (2, None), (3, [2.0] * 24)], "query_id int, embedding array<double>")
    found = vector_index.search(asked, path, 3).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in found) == [(q, 5000 + i, 1.0, i + 1) for q in (1, 3) for i in range(3)]
    kept = vector_index.search(asked, path, 3, probes=1.0, where="source = 's1'").collect()
    assert kept and all(r["chunk_id"] % 3 == 1 for r in kept)


def test_creation_checks_names_and_dimension(spark, tmp_path):
    with pytest.raises(ValueError, match="reserved names: cell"):
        vector_index.create(made(spark, 10).withColumn("cell", F.lit(1)), str(tmp_path / "a"))
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "chunk_id int, embedding array<double>")
    with pytest.raises(ValueError, match="vectors of 1 to 2 numbers"):
        vector_index.create(odd, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        vector_index.create(spark.createDataFrame([(1, [])], "chunk_id int, embedding array<double>"), str(tmp_path / "c"))
    vector_index.create(made(spark, 50), str(tmp_path / "d"))
    with pytest.raises(Exception, match="24 numbers"):
        vector_index.search(odd.where("chunk_id = 1").withColumnRenamed("chunk_id", "query_id"), str(tmp_path / "d"), 3).collect()


def test_empty_and_tiny_tables(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0] * 24)], "query_id int, embedding array<double>")
    vector_index.create(made(spark, 1).limit(0), str(tmp_path / "none"))
    assert vector_index.search(asked, str(tmp_path / "none"), 3).collect() == []
    vector_index.create(made(spark, 2), str(tmp_path / "two"))
    assert len(vector_index.search(asked, str(tmp_path / "two"), 3, probes=1.0).collect()) == 2


def test_exact_search_equals_all_pairs(spark, tmp_path):
    """Near copies that codes do not tell apart, copies of one vector, and single vectors, with few probes and few candidates."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    vectors_of = [base[0] + 0.02 * rng.normal(size=24) for _ in range(300)] + [base[1]] * 150 + list(base) + [np.zeros(24)]
    chunks = spark.createDataFrame([(i, [float(v) for v in x], f"s{i % 3}") for i, x in enumerate(vectors_of)], "chunk_id long, embedding array<float>, source string")
    path = str(tmp_path / "index")
    vector_index.create(chunks, path)
    queries = chunks.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    settings = {"probes": 0.02, "again": 1}
    for k in (1, 4):
        expected = rows(vectors.dense_top_k(queries, chunks, k))
        assert k == 1 or rows(vector_index.search(queries, path, k, **settings)) != expected
        assert rows(vector_index.search(queries, path, k, exact=True, **settings)) == expected
    some = vectors.dense_top_k(queries, chunks.where("source = 's1'"), 4)
    assert rows(vector_index.search(queries, path, 4, exact=True, where="source = 's1'", **settings)) == rows(some)
