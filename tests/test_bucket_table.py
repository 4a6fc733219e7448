"""Upserts by buckets against a dictionary, the files they touch, and what readers see in between."""

import glob
import os
import random

import pytest

from ragloom.sources.bucket_table import BucketTable

DDL = "course_id string, namespace string, chunk_id string, version long, text string"


def merged(held, rows, wins):
    sign = 1 if wins == "last" else -1
    for r in rows:
        key, own = r[:3], (r[3] is not None, r[3] or 0)
        old = held.get(key)
        if old is None:
            held[key] = r
            continue
        before = (old[3] is not None, old[3] or 0)
        if (own > before if sign == 1 else own < before) or own == before and wins == "last":
            held[key] = r
    return held


def batch(seed, n, courses=("c1", "c/2", "007", None)):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = (rng.choice(courses), rng.choice(["qna", "documents"]), f"id{rng.randint(0, 60)}")
        rows[key] = (*key, rng.choice([None, 1, 2, 3]), f"text {rng.random()}")
    return list(rows.values())


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table = BucketTable.create(spark, str(tmp_path / "t"), DDL, buckets=4)
    assert table.read().collect() == []
    held, versions = {}, []
    for i, wins in enumerate(["last", "last", "first", "last"]):
        rows = batch(i, 60)
        table.upsert(spark.createDataFrame(rows, DDL).repartition(3), wins)
        held = merged(held, rows, wins)
        versions.append(sorted(map(str, held.values())))
        assert plain(table.read()) == versions[-1]
    assert plain(table.read(commit=2)) == versions[1]
    assert BucketTable(spark, str(tmp_path / "t")).keys == ["course_id", "namespace", "chunk_id"]
    assert table.vacuum() > 0 and plain(table.read()) == versions[-1] and table.commits() == [4]


def test_only_met_buckets_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable.create(spark, path, DDL, buckets=16)
    table.upsert(spark.createDataFrame([(f"c{i % 3}", "qna", f"id{i}", 1, "old") for i in range(400)], DDL))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}
    before = files()
    assert len({os.path.dirname(f) for f in before}) == 48
    done = table.upsert(spark.createDataFrame([("c1", "qna", "id1", 2, "new"), ("c1", "qna", "fresh", 1, "new")], DDL))
    assert done["rewritten"] <= 2 and done["buckets"] == 48
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) == done["rewritten"]
    assert table.read().where("text = 'new'").count() == 2 and table.read().count() == 401
    plan = table.rows_of(table.manifest().where("bucket = 3"))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable.create(spark, path, DDL, buckets=2)
    table.upsert(spark.createDataFrame([("c", "n", "a", 1, "x")], DDL))
    spark.createDataFrame([("c", "n", "a", 9, "half")], DDL).selectExpr("*", "0 as bucket").write.partitionBy("course_id", "namespace", "bucket").parquet(f"{path}/data/commit=2")
    assert [r.text for r in table.read().collect()] == ["x"]
    table.upsert(spark.createDataFrame([("c", "n", "b", 1, "y")], DDL))
    assert sorted(r.text for r in table.read().collect()) == ["x", "y"]


def test_repeats_missing_columns_and_no_rows(spark, tmp_path):
    table = BucketTable.create(spark, str(tmp_path / "t"), DDL, buckets=2)
    assert table.upsert(spark.createDataFrame([], DDL)) == {"commit": 0, "rewritten": 0, "buckets": 0}
    rows = spark.createDataFrame([("c", "n", "a", 1, "clash")] * 5 + [("c", "n", "a", 4, "clash")], "course_id string, namespace string, chunk_id string, version int, __new string")
    table.upsert(rows)
    assert [tuple(r) for r in table.read().collect()] == [("c", "n", "a", 4, None)]
    for ddl in ("course_id string, namespace string, chunk_id string", DDL + ", bucket int"):
        with pytest.raises(ValueError):
            BucketTable.create(spark, str(tmp_path / "u"), ddl)
    with pytest.raises(ValueError):
        table.upsert(rows, "middle")
    with pytest.raises(ValueError):
        table.read(commit=9)
