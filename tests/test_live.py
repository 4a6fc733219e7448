"""The live report against the single metrics, and sketches against exact ranks."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import live, metrics


def scenario_tables(spark, n=12):
    rng = random.Random(5)
    sources = ["qna", "image", "audio", "youtube", "documents", "handwritten"]
    listed, counts, scenarios = [], [], []
    for s in range(n):
        size = 0 if s == 3 else rng.randint(1, 14)
        for rank in range(1, size + 1):
            words = " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 15, 40])))
            listed.append((s, f"c{rank}", rng.choice(sources), rank, round(1 / rank + rng.random() / 100, 3), words, rng.choice([None, None, 1, 2]), rng.choice(["f.pdf", "", None]), rng.choice(["t", None]), rng.choice(["x", ""])))
        counts += [(s, 1, 5), (s, 2, 3)] if s != 4 else []
        scenarios.append((s, rng.choice(["ask", "quiz"]), "The answer says something of it [1]. Another sentence without any context here [2][9].", "The context says something.", ["answer", "zzz"], "short", "bullet_summary", rng.sample(sources, s % 4), 1000.0 * s, "boom" if s == 5 else None))
    return (
        spark.createDataFrame(scenarios, "scenario_id int, mode string, answer string, context string, keywords array<string>, length string, format string, expected_sources array<string>, latency_ms double, error string"),
        spark.createDataFrame(listed, "scenario_id int, chunk_id string, source string, rank int, score double, text string, grade int, source_file string, topic string, section_title string"),
        spark.createDataFrame(counts, "scenario_id int, grade int, n long"),
    )


def test_report_equals_the_single_metrics(spark):
    scenarios, listed, counts = scenario_tables(spark)
    report, seen = live.live_report(scenarios, listed, counts)
    rows = {r["scenario_id"]: r for r in report.collect()}
    assert len(rows) == 12
    for k, linear, columns in ((5, True, {"ndcg": "ndcg_at_5", "precision": "precision_at_5"}), (10, True, {"ndcg": "ndcg_at_10"}), (10, False, {"ndcg": "ndcg", "precision": "precision", "recall": "recall", "mrr": "mrr", "score_gap": "score_gap"})):
        for r in metrics.graded_lists(listed, counts, ["scenario_id"], k, linear).collect():
            for own, name in columns.items():
                assert rows[r["scenario_id"]][name] == pytest.approx(r[own], abs=6e-5), name
    asked = scenarios.join(listed.groupBy("scenario_id").agg(F.count("*").alias("n_chunks")), "scenario_id")
    for r in metrics.answers(asked).collect():
        for name in ("context_utilisation", "citation_coverage", "keyword_recall", "hallucination", "plan_alignment"):
            assert rows[r["scenario_id"]][name] == pytest.approx(r[name], abs=6e-5)
    for r in live.chunking_report(listed, ["scenario_id"]).where("source is null").collect():
        own = rows[r["scenario_id"]]
        assert (own["chunks_returned"], own["completeness"], own["size_ok"], own["richness"]) == (r["total"], r["completeness"], r["size_ok"], r["richness"])
    assert rows[3]["chunks_returned"] == 0 and rows[3]["mrr"] == 0.0 and rows[3]["completeness"] == 0.0 and rows[4]["ndcg"] == 0.0
    worked = [r for r in rows.values() if r["error"] is None]
    found = seen.get
    assert (found["scenarios"], found["errored"]) == (12, 1) and found["avg_mrr"] == pytest.approx(sum(r["mrr"] for r in worked) / 11)
    assert live.gates(found)["latency_ok"] and not live.gates(found)["passed"]
    assert live.gates({"scenarios": 0}) == {"retrieval_ok": False, "chunking_ok": False, "faithfulness_ok": False, "latency_ok": False, "passed": False}


def test_chunks_of_all_sources_in_one_pass(spark):
    _, listed, _ = scenario_tables(spark)
    report = live.chunking_report(listed.unionByName(listed.limit(1).withColumn("source", F.lit(None).cast("string"))))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2
    rows = {r["source"]: r for r in report.collect()}
    assert rows[None]["total"] == sum(r["total"] for s, r in rows.items() if s) and rows["unknown"]["total"] == 1
    for source, fields in live.LIVE_FIELDS.items():
        own = [r for r in listed.collect() if r["source"] == source]
        full = [round(sum(bool(r[f]) if f in listed.columns else False for f in fields) / len(fields), 4) for r in own]
        assert rows[source]["completeness"] == pytest.approx(sum(full) / len(full), abs=6e-5)
        assert rows[source]["size_ok"] == pytest.approx(sum(15 <= len(r["text"].split()) <= 2000 for r in own) / len(own), abs=6e-5)
    assert live.chunking_report(listed.limit(0)).collect() in ([], live.chunking_report(listed.limit(0)).collect())


def test_sketches_keep_their_bound_and_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), 86_400 * rng.randint(1, 9), rng.choice([rng.random(), rng.gauss(5, 2), 3.0])) for _ in range(60_000)] + [("a", 86_400, None), ("c", 86_400, 7.0)]
    df = spark.createDataFrame(rows, "stage string, at long, ms double").withColumn("ts", F.timestamp_seconds("at")).repartition(7)
    days = live.daily_sketches(df, ["stage"], "ms")
    assert days.count() == 19 and days.select(F.max(F.length("sketch"))).first()[0] < 16_000
    at = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    for r in live.percentiles(days, ["stage"], at).collect():
        own = sorted(v for s, _, v in rows if s == r["stage"] and v is not None)
        assert (r["n"], r["min"], r["max"]) == (len(own), own[0], own[-1])
        for name, q in at.items():
            low, high = sum(v < r[name] for v in own) / len(own), sum(v <= r[name] for v in own) / len(own)
            assert low - live.RANK_ERROR <= q <= high + live.RANK_ERROR or len(own) == 1
    assert live.percentiles(live.daily_sketches(df.limit(0), ["stage"], "ms"), ["stage"], at).collect() == []
