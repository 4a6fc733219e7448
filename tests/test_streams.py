"""Stateful streams against their batch forms, and what they keep."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import cache
from ragloom.streaming import rate_limit, result_cache


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(spark, batches, made, tmp_path, name):
    """Rows that a stream gives for these batches, one after another."""
    schema = batches[0].schema
    os.makedirs(tmp_path / "in")
    for i, df in enumerate(batches):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
        for folder, _, files in os.walk(f"{tmp_path}/in/{i:03}"):
            for f in files:
                os.utime(f"{folder}/{f}", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = made(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(300)
    return spark.table(name).collect()


def state(spark, tmp_path, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{tmp_path}/check").collect()


def spending(seed, n):
    rng = random.Random(seed)
    at, rows = 86_400 * 40 + 80_000.0, []
    for i in range(n):
        at += rng.choice([0, 0.5, 5, 20, 45, 90])
        rows.append((i, rng.randint(1, 4), rng.choice(["ask", "quiz"]), rng.choice(["student", "teacher", None, "student"]), at, rng.choice([-5, 0, 900, 20_000, 60_000, 170_000])))
    return rows


def test_decisions_of_all_roles_equal_the_batch(spark, tmp_path):
    rows = spending(1, 240)
    df = spark.createDataFrame(rows, "event_id long, user_id long, mode string, role string, at double, tokens long").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    batches = [df.where(f"event_id between {a} and {a + 39}") for a in range(0, 240, 40)]
    found = {r.event_id: r for r in replay(spark, batches, rate_limit.stream_decisions, tmp_path, "all_roles")}
    expected = {r.event_id: r for r in rate_limit.decisions(df).collect()}
    assert found.keys() == expected.keys()
    assert {r.reason for r in expected.values()} >= {None, "window", "bucket", "day"}
    for k, r in expected.items():
        own = found[k]
        assert (own.used_window, own.used_day, own.allowed, own.reason, own.retry_after) == (r.used_window, r.used_day, r.allowed, r.reason, r.retry_after)
        assert own.available == pytest.approx(r.available, abs=1e-6)


def test_idle_users_are_forgotten_and_come_back_fresh(spark, tmp_path):
    day = 86_400
    rows = [(1, 1, "ask", "student", day * 10.0, 79_999), (2, 2, "ask", "teacher", day * 10 + 1.0, 5), (3, 2, "ask", None, day * 11 + 7200.0, 5), (4, 2, "ask", None, day * 11 + 7300.0, 5), (5, 1, "quiz", "student", day * 12.0, 10), (6, 3, "ask", "student", day * 12 + 5.0, 1)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, mode string, role string, at double, tokens long").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    found = {r.event_id: r for r in replay(spark, [df.where(f"event_id = {i}") for i in range(1, 5)], rate_limit.stream_decisions, tmp_path / "a", "idle_a")}
    assert {r.key.user_id for r in state(spark, tmp_path / "a", "day")} == {2}  # user 1's day is over
    found = {r.event_id: r for r in replay(spark, [df.where(f"event_id = {i}") for i in range(1, 7)], rate_limit.stream_decisions, tmp_path / "b", "idle_b")}
    for r in rate_limit.decisions(df).collect():
        assert (found[r.event_id].available, found[r.event_id].used_day, found[r.event_id].reason) == (r.available, r.used_day, r.reason)


def test_a_stream_without_roles_and_late_events(spark, tmp_path):
    rows = [(1, 1, "ask", 1000.0, 60_000), (2, 1, "ask", 1001.0, 0), (3, 1, "ask", 10_000.0, 5), (4, 1, "ask", 10_001.0, 5), (5, 1, "ask", 2000.0, 5)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, mode string, at double, tokens long").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    found = {r.event_id: r for r in replay(spark, [df.where("event_id <= 2"), df.where("event_id = 3"), df.where("event_id = 4"), df.where("event_id = 5")], rate_limit.stream_decisions, tmp_path, "no_roles")}
    assert sorted(found) == [1, 2, 3, 4] and found[2].reason == "window" and found[2].retry_after == 10  # the last is beyond the watermark


CACHE = "course string, mode string, at long, asked boolean, id string, query string, embedding array<double>"


def cached(seed, n):
    rng = random.Random(seed)
    rows, at = [], 1_000_000
    for i in range(n):
        at += rng.choice([0, 1, 400, 4000])
        v = [rng.choice([0.0, 1.0, 1.0, 1.05]) for _ in range(4)]
        rows.append((rng.choice(["c1", "c2"]), "ask", at, rng.random() < 0.4, f"{i:04}", rng.choice(["What is it?", "what is  IT", "why", f"q{i}", f"q{i - 3}"]), v if rng.random() < 0.9 else None))
    return rows


def batch_answer(spark, rows, q, most, ttl):
    """cache.retention and cache.lookup for one question, over what came before it."""
    known = [r for r in rows if not r[3] and (r[2], r[4]) < (q[2], "~") and r is not q]
    df = spark.createDataFrame(known, CACHE).withColumn("created", F.timestamp_seconds("at")).withColumnRenamed("id", "entry_id")
    live = cache.retention(df, F.timestamp_seconds(F.lit(q[2])), most, ttl)
    asked = spark.createDataFrame([q], CACHE).withColumnRenamed("id", "query_id")
    exact = cache.exact_hits(asked, live).collect()
    if exact:
        return exact[0].entry_id, 1.0
    near = cache.nearest_hits(asked.where("embedding is not null"), live.where("embedding is not null")).collect()
    return (near[0].entry_id, near[0].similarity) if near else (None, None)


def test_cache_answers_equal_the_batch(spark, tmp_path):
    rows, most, ttl = cached(3, 60), 5, 6000
    df = spark.createDataFrame(rows, CACHE).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    batches = [df.where(f"id >= '{a:04}' and id < '{a + 15:04}'") for a in range(0, 60, 15)]
    found = {r.query_id: (r.entry_id, r.similarity) for r in replay(spark, batches, lambda s: result_cache.stream_lookups(s, most=most, ttl=ttl), tmp_path, "cached")}
    asked = [r for r in rows if r[3]]
    assert sorted(found) == sorted(r[4] for r in asked)
    assert {f"{k}:{v}" for k, v in found.items()} == {f"{q[4]}:{batch_answer(spark, rows, q, most, ttl)}" for q in asked}
    assert len({v[0] for v in found.values()}) > 3


def test_cache_keeps_what_retention_keeps(spark, tmp_path):
    """Late results take their place, expired ones go with the watermark even where nothing is asked, and what is too late is dropped."""
    rows = [("c1", "ask", 10_000 + 10 * i, False, f"a{i}", f"q{i}", [1.0, float(i)]) for i in range(8)]
    batches = [rows, [("c1", "ask", 10_035, False, "late", "x", [2.0, 1.0])], [("c2", "ask", 14_000, False, "b0", "y", [0.0, 1.0])], [("c2", "ask", 14_001, False, "b1", "y", None)], [("c1", "ask", 9000, False, "too late", "z", [1.0])]]
    frames = [spark.createDataFrame(b, CACHE).withColumn("ts", F.timestamp_seconds("at")).drop("at") for b in batches]
    made = lambda s: result_cache.stream_lookups(s, most=5, ttl=3600, late="5 minutes")
    replay(spark, frames[:2], made, tmp_path / "a", "kept_a")
    all_ = spark.createDataFrame(rows + batches[1], CACHE).withColumn("created", F.timestamp_seconds("at")).withColumnRenamed("id", "entry_id")
    assert {r.user_map_key.entry_id for r in state(spark, tmp_path / "a", "entries")} == {r.entry_id for r in cache.retention(all_, F.timestamp_seconds(F.lit(10_071)), 5, 3600).collect()} == {"a4", "a5", "a6", "a7", "late"}
    replay(spark, frames, made, tmp_path / "b", "kept_b")
    left = {r.user_map_key.entry_id for r in state(spark, tmp_path / "b", "entries")}
    now = 14_001 - 300  # the watermark
    assert left == {"b0", "b1"} | {r.entry_id for r in cache.retention(all_, F.timestamp_seconds(F.lit(now)), 5, 3600).collect()}


def test_cache_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], CACHE).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert replay(spark, [empty], result_cache.stream_lookups, tmp_path, "no_rows") == []
