"""Operators on rows worked out by hand or by plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as tx
from ragloom.operators import cache, chunking, keywords, metrics, ranking, vectors
from ragloom.plans import planner
from ragloom.sources import readers, writers
from ragloom.streaming import rate_limit


def values(spark, column, *texts):
    """A text expression's values for literal texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_text_scalars(spark):
    assert values(spark, tx.n_words, "a  b\tc", "", None, "  ") == [3, 0, 0, 0]
    assert values(spark, tx.token_estimate, "a b c d", "", None) == [5, 1, 1]
    assert values(spark, tx.tokens, "The École of_x and A1 b", None, "the of") == [["cole", "of_x", "a1"], [], []]
    assert values(spark, tx.sentences, "One. Two! Three", "", None) == [["One.", "Two!", "Three"], [], []]
    assert values(spark, lambda t: tx.time_label(t.cast("double")), "0", "75.9", "3661") == ["00:00", "01:15", "01:01:01"]
    assert values(spark, tx.cleaned, " a\x00\n\n\n\nb ", "x") == ["a\n\nb", "x"]
    assert values(spark, tx.normalised, "com-\nputer  a\r\nb\n\n\n\nc") == ["computer a\nb\n\nc"]
    assert values(spark, tx.video_id, "https://youtu.be/abcdefghijk", "https://x.y/watch?v=ABCDEFGHIJ_&t=1", "abcdefghij-", "nothing") == ["abcdefghijk", "ABCDEFGHIJ_", "abcdefghij-", None]
    assert values(spark, tx.difficulty, "A difficult one, easy too", "none", None) == ["hard", None, None]
    assert values(spark, tx.marks, "x [12 marks] y [3 pts]", "12 marks") == [12, None]
    assert values(spark, tx.year, "1999 and 2023, not 20231", "no") == [2023, None]
    assert values(spark, tx.json_object, '```json\n{"a": {"b": 1}}\n```', "none") == ['{"a": {"b": 1}}', None]
    assert values(spark, tx.looks_like_section, "Chapter 3 Waves", "3.1 Intro", "Plain text that goes on and ends.", "Quantum Field Theory", "not a title here") == [True, True, False, True, False]
    assert values(spark, lambda t: tx.page_label(t.cast("int"), F.lit(5)), "3", "5", None) == ["3–5", "5", "5"]
    assert values(spark, lambda t: tx.index_name(t), "My Course! 101")[0].startswith("course-my-course-101-")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_top_k_ranks_ties_by_id_and_works_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    chunks = spark.createDataFrame([(i, [1.0, float(i % 3)], i % 2) for i in range(12)], "chunk_id int, embedding array<double>, part int")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<double>")
    found = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.dense_top_k(queries, chunks, 3).collect()}
    assert [found[1, k] for k in (1, 2, 3)] == [0, 3, 6] and [found[2, k] for k in (1, 2, 3)] == [2, 5, 8]
    assert vectors.dense_top_k(queries, chunks, 2, by=["part"], where={"chunk_id": {"$gte": 4, "$lt": 10}}).count() == 8
    assert vectors.dense_top_k(queries.limit(0), chunks, 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in reversed(range(300))], "chunk_id int, embedding array<double>")
    assert sorted(r.chunk_id for r in vectors.dense_top_k(queries.limit(1), same, 4).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="unknown filter"):
        vectors.filters({"a": {"$no": 1}})


def test_hashed_search_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, (np.array(v) + rng.normal(size=16) * 0.1).tolist()) for i, v in rows[::20]], "query_id int, embedding array<double>")
    exact = {(r.query_id, r.chunk_id) for r in vectors.dense_top_k(queries, chunks, 1).collect()}
    found = {(r.query_id, r.chunk_id) for r in vectors.hashed_top_k(queries, chunks, 1, tables=10, bits=5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_blocks_meet_in_steps_and_hashed_pairs_are_no_rows(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    own = rng.normal(size=(120, 6))
    own[40:80] = own[7]
    chunks = spark.createDataFrame([(i, v.tolist(), f"s{i % 3}" if i % 4 else None) for i, v in enumerate(own)], "chunk_id int, embedding array<double>, part string").unionByName(spark.createDataFrame([(500, None, "s1")], "chunk_id int, embedding array<double>, part string"))
    queries = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    asked = [i for i in range(120) if i % 10 == 0]
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    planes = np.random.default_rng(3).normal(size=(4 * 6, 6))
    codes = (own @ planes.T > 0).reshape(120, 4, 6) @ (1 << np.arange(6))
    met = (codes[:, None] == codes[None]).any(2)
    hashed = {(q, c, r + 1) for q in asked for r, c in enumerate(sorted(np.flatnonzero(met[q]).tolist(), key=lambda c: (-score[q, c], c))[:4])}
    part = lambda c: f"s{c % 3}" if c % 4 else None
    dense = {(q, p, c, r + 1) for q in asked for p in ("s0", "s1", "s2", None) for r, c in enumerate(sorted((c for c in range(120) if part(c) == p), key=lambda c: (-score[q, c], c))[:4])}
    for limit in (64, 4000, 1 << 22):
        monkeypatch.setattr(vectors, "SCORE_BYTES", limit)
        found = vectors.hashed_top_k(queries, chunks.unionByName(chunks), 4, tables=4, bits=6)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in found.collect()} == hashed
        assert {(r.query_id, r.part, r.chunk_id, r["rank"]) for r in vectors.dense_top_k(queries, chunks, 4, by=["part"]).collect()} == dense
    assert "Generate" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_hashed_search(spark, sf):
    import os

    from ragloom import catalog

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    exact, found = ({(r.query_id, r.chunk_id) for r in f(spark, folder).collect()} for f in (catalog.r4_dense_topk, catalog.r4_hashed_topk))
    assert len(exact & found) >= 0.9 * len(exact)


def test_sequential_clusters(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.05]), (2, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc int, at int, embedding array<double>")
    found = {(r.doc, r.at): r.cluster for r in vectors.sequential_clusters(df, "doc", "at").collect()}
    assert found == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 0, (2, 0): 0}


def test_bm25_by_hand(spark):
    docs = ["wave energy wave", "energy of light", "sound"]
    df = spark.createDataFrame([(1, i, t, "wave energy", i) for i, t in enumerate(docs)] + [(2, 0, "x1", "the of", 0)], "q int, chunk_id int, text string, query string, rank int")
    found = {(r.q, r.chunk_id): (r.bm25, r.bm25_rank) for r in ranking.bm25(df, ["q"]).collect()}
    words = [["wave", "energy", "wave"], ["energy", "light"], ["sound"]]
    n, avg = 3, 2.0
    df_ = {t: sum(t in w for w in words) for t in {x for w in words for x in w}}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df_.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    scores = [sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("wave", "energy") if t in w) for w in words]
    for i, s in enumerate(scores):
        assert found[1, i][0] == pytest.approx(s / max(scores), abs=1e-6)
    assert found[1, 0][1] == 1 and found[2, 0] == (0.0, 1)


def greedy(rows, k, weight):
    """The selection in plain Python: rows are (id, score, file, place)."""
    chosen = [max(range(len(rows)), key=lambda i: (rows[i][1], -i))]
    while len(chosen) < k:
        def value(i):
            worst = 0.0
            for j in chosen:
                same = rows[i][2] == rows[j][2]
                near = same and abs(rows[i][3] - rows[j][3]) <= 2
                worst = max(worst, 0.85 if near else 0.5 if same else rows[i][1] * rows[j][1])
            return weight * rows[i][1] - (1 - weight) * worst

        chosen.append(max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (value(i), -i)))
    return [rows[i][0] for i in chosen]


def test_diverse_equals_plain_python(spark):
    rows = [(i, round(0.95 - 0.03 * i, 4), f"f{i % 3}", i // 3) for i in range(12)]
    df = spark.createDataFrame([(1, i, s, i + 1, f, f, p) for i, s, f, p in rows] + [(2, 5, 0.5, 1, "a", "a", 0)], "query_id int, chunk_id int, score double, rank int, source_file string, file_name string, place int")
    found = sorted((r.query_id, r.mmr_rank, r.chunk_id) for r in ranking.diverse(df, ["query_id"], F.lit(5), F.lit(0.6)).collect())
    assert [c for q, _, c in found if q == 1] == greedy(rows, 5, 0.6) and [c for q, _, c in found if q == 2] == [5]


def test_distinct_questions(spark):
    df = spark.createDataFrame([(["what is energy flow", "energy flow", "explain the wave", "of"],)], "q array<string>")
    assert df.select(ranking.distinct_questions(F.col("q"))).first()[0] == ["what is energy flow", "explain the wave", "of"]


def test_boosts(spark):
    names = "marks_hint int, year_hint int, chunk_type string, has_equations boolean, content_type string, confidence double, ocr_confidence double, has_formula boolean, strategy string, avg_confidence double, has_table boolean"
    none = [None] * 11
    rows = [("qna", 5, -1, "single_qa", *none[3:]), ("image", *none[:6], 60.0, True, *none[8:]), ("audio", *none[:8], "concept_block", 0.5, None), ("youtube", *none), ("handwritten", *none[:3], True, "equation", 0.5, *none[6:])]
    df = spark.createDataFrame(rows, f"source string, {names}").withColumn("signals", F.array(F.lit("Exam formula")))
    found = [round(r[0], 6) for r in df.select(ranking.metadata_boost(F.col("source"), F.col("signals"))).collect()]
    assert found == [round(1.12 * 1.10, 6), round(0.8 * 1.12, 6), round(1.08 * 0.9, 6), 1.0, round(1.15 * 1.08 * 0.85, 6)]
    assert round(df.select(ranking.metadata_boost(F.col("source"), F.col("signals"), compat=True)).first()[0], 6) == round(1.12 * 1.05 * 1.10, 6)


def test_plan_and_retrieve(spark):
    asked = spark.createDataFrame([(1, "compare a and b", "ask", [1.0, 0.0]), (2, "what", "quiz", [0.0, 1.0])], "query_id int, query string, mode string, embedding array<double>")
    plans = planner.plan(asked.drop("embedding"))
    weight = {(r.query_id, r.source): (r.weight, r.dense_k) for r in plans.collect()}
    assert weight[1, "documents"] == (2.86, 7) and weight[2, "qna"] == (2.8, 9) and len(weight) == 12
    chunks = spark.createDataFrame([(f"c{i}", ["qna", "documents", "audio"][i % 3], f"text {i}", [math.cos(i), math.sin(i)]) for i in range(30)], "chunk_id string, source string, text string, embedding array<double>")
    found = planner.retrieve(asked.drop("mode"), plans, chunks, 5).collect()
    assert sorted(r["rank"] for r in found if r.query_id == 1) == [1, 2, 3, 4, 5] and all(r.methods for r in found)


def test_sliding_windows(spark):
    for n in range(1, 25):
        df = spark.createDataFrame([(1, i, f"s{i}") for i in range(n)], "k int, at int, text string")
        found = sorted((r.window_index, r.text, r.overlap_prev, r.overlap_next) for r in chunking.sliding_windows(df, ["k"], "at").collect()) if n in (1, 6, 7, 11, 24) else None
        if found is None:
            continue
        expected, start = [], 0
        while True:
            expected.append(" ".join(f"s{i}" for i in range(start, min(start + 6, n))))
            if start + 6 >= n:
                break
            start += 4
        assert [f[1] for f in found] == expected
        assert [f[2] for f in found] == [0] + [2] * (len(expected) - 1) and [f[3] for f in found] == [2] * (len(expected) - 1) + [0]


def test_concept_blocks_cover_every_segment(spark):
    rows = [(1, i, ("wave " if i < 5 else "light ") * 2, ["wave", "light"]) for i in range(12)] + [(2, i, "x", []) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, at int, text string, topics array<string>")
    found = sorted((r.k, r.block, r.first, r.last, r.topic) for r in chunking.concept_blocks(df, ["k"], "at").collect())
    assert [f[:4] for f in found if f[0] == 2] == [(2, 0, 0, 3), (2, 1, 4, 7), (2, 2, 8, 8)]
    one = [f for f in found if f[0] == 1]
    assert one[0][2] == 0 and one[-1][3] == 11 and all(a[3] + 1 == b[2] for a, b in zip(one, one[1:])) and {f[4] for f in one} == {"wave", "light"}


def test_as_of_chapter(spark):
    snippets = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "a", 25.0), (4, "b", 3.0)], "id int, video string, t double")
    chapters = spark.createDataFrame([("a", 10.0, "one"), ("a", 20.0, "two")], "video string, chapter_start double, title string")
    found = {r.id: (r.chapter, r.chapter_index) for r in chunking.as_of_chapter(snippets, chapters, "video", "t").collect()}
    assert found == {1: ("one", 0), 2: ("one", 0), 3: ("two", 1), 4: ("Unknown", -1)}


def test_questions(spark):
    page = "Intro to drop\n1. What is energy? [5 marks]\nAnswer: The hard capacity to do work in 2021.\n2) Define the wave equation please\n"
    pages = spark.createDataFrame([(1, 1, page), (1, 2, "Q3. Explain light and its sources\nSolution: it is a wave"), (2, 1, "No numbering here at all\n\nbut two long paragraphs of text")], "doc int, page int, text string")
    blocks = chunking.question_blocks(pages, "doc", lossless=False)
    rows = blocks.orderBy("doc", "block").collect()
    assert [(r.doc, r.page_start) for r in rows] == [(1, 1), (1, 1), (1, 1), (1, 2), (2, 1), (2, 1)] or [(r.doc, r.page_start) for r in rows][:2] == [(1, 1), (1, 1)]
    assert rows[0].text.startswith("1. What is energy?") and not any("Intro" in r.text for r in rows)
    lossless = chunking.question_blocks(pages, "doc")
    assert any("Intro" in r.text for r in lossless.collect())
    for name, value in chunking.parsed_block(F.col("text")).items():
        blocks = blocks.withColumn(name, value)
    first = blocks.where("doc = 1 and block = 0").first()
    assert first.marks_hint == 5 and first.question.startswith("1. What is energy?")
    made = chunking.qna_chunks(blocks.withColumn("cluster", F.lit(0)), "doc", most=10).collect()
    assert {(r.doc, r.half) for r in made} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_post_process_links(spark):
    df = spark.createDataFrame([(1, 0, "a b", "x"), (1, 1, " a b ", "y"), (1, 2, "c d", "z"), (1, 3, None, "n")], "doc int, at int, text string, chunk_id string")
    found = chunking.post_process(df.where("text is not null"), "doc", "at").orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.prev_chunk_id, r.next_chunk_id, r.total_chunks) for r in found] == [("x", None, "z", 2), ("z", "x", None, 2)]


def test_packers_keep_every_word(spark):
    import random

    draw = random.Random(4)
    rows = [(d, i, " ".join(f"w{d}_{i}_{k}" + ("." if draw.random() < 0.1 else "") for k in range(draw.choice([3, 40, 700])))) for d in range(3) for i in range(12)]
    units = spark.createDataFrame(rows, "doc int, at int, text string")
    found = chunking.word_windows(units, "doc", most=200, overlap=20).collect()
    for d in range(3):
        words = {w for k, _, t in rows if k == d for w in t.split()}
        own = [r for r in found if r.doc == d]
        assert {w for r in own for w in r.text.split()} == words and sorted(r.chunk_index for r in own) == list(range(len(own)))
        assert all(int(r.n_words * 1.3) <= 200 + 26 + 20 for r in own)
    elements = units.select("doc", "at", F.when(F.col("at") % 5 == 0, "Title").when(F.col("at") % 7 == 0, "Table").otherwise("Paragraph").alias("kind"), F.col("text").alias("content"), F.lit(1).alias("page"))
    packed = chunking.element_chunks(elements, "doc").collect()
    assert all(len(r.text) <= chunking.HARD + chunking.TINY + 2 or r.standalone for r in packed)
    body = {w for d, i, t in rows if i % 5 for w in t.split()}
    assert body <= {w for r in packed for w in r.text.split()} | {w[-n:] for w in body for n in range(1, len(w))} | body
    captions = units.select("doc", F.col("at").cast("double").alias("start"), "text", F.floor(F.col("at") / 4).cast("string").alias("chapter"))
    spoken = chunking.caption_chunks(captions, "doc").collect()
    assert {w for r in spoken for w in r.text.split()} == {w for _, _, t in rows for w in t.split()}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "energy wave energy light wave zeta"), (2, ""), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.keywords for r in keywords.document_keywords(df, most=3).collect()} == {1: "energy, wave, light", 2: "", 3: ""}
    assert keywords.topic_labels(df, ["doc_id"]).where("doc_id = 2").first().topic_label == "general"


def test_retrieval_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, c, i + 1, 1.0 - i / 10) for i, c in enumerate("xaby")] + [(2, "q", 1, 0.5)], "s int, chunk_id string, rank int, score double")
    grades = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2)], "s int, chunk_id string, grade int")
    found = {r.s: r for r in metrics.retrieval(ranked, grades, ["s"], 3).collect()}
    dcg = 1 / math.log2(3) + 3 / math.log2(4)
    ideal = 3 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert found[1].mrr == 0.5 and found[1].ndcg == pytest.approx(dcg / ideal) and found[1].precision == pytest.approx(2 / 3) and found[1].recall == pytest.approx(2 / 3)
    assert (found[2].mrr, found[2].ndcg, found[2].recall, found[2].score_gap) == (0.0, 0.0, 0.0, 0.0)
    linear = {r.s: r.ndcg for r in metrics.retrieval(ranked, grades, ["s"], 3, linear=True).collect()}
    assert linear[1] == pytest.approx((1 / math.log2(3) + 2 / math.log2(4)) / (2 + 2 / math.log2(3) + 1 / math.log2(4)))


def test_answer_checks(spark):
    row = ("Energy is conserved in waves [1]. Nothing else matters here at all. Short one [9].", "energy waves conserved", 2, ["Energy", "missing"], "short", "bullet_summary")
    df = spark.createDataFrame([row, (None, None, 0, [], None, None)], "answer string, context string, n_chunks int, keywords array<string>, length string, format string")
    a, b = metrics.answers(df).collect()
    assert (a.context_utilisation, a.citation_coverage, a.keyword_recall, a.hallucination, a.length_ok) == (0.5, 0.0, 0.5, 0.5, False) or a.citation_coverage == 0.5
    assert (b.context_utilisation, b.hallucination, b.keyword_recall, b.plan_alignment) == (0.0, 0.0, 1.0, 1.0)


def test_other_metrics(spark):
    one = spark.createDataFrame([("total_ms", 3800.0), ("total_ms", 4200.0), ("total_ms", 4900.0)], "stage string, ms double")
    r = metrics.latency(one).first()
    assert (round(r["mean"], 1), round(r.sd, 1), r.p50, round(r.p95), round(r.p99), r.passed) == (4300.0, 556.8, 4200.0, 4830, 4886, True)
    plan = spark.createDataFrame([(["qna", "audio"], ["qna", "image"], ["audio"]), ([], ["qna"], [])], "planned array<string>, expected array<string>, excluded array<string>")
    assert [(x.precision, x.recall) for x in metrics.planner_selection(plan).collect()] == [(0.0, 0.5), (0.0, 0.0)]
    assert metrics.size_stats(spark.createDataFrame([(1, "one")], "k int, text string"), ["k"]).first().sd == 0.0
    gates = metrics.health(spark.createDataFrame([(0.9, 0.2)], "mrr double, hallucination double"), {"mrr": 0.4}, {"hallucination": 0.35}).first()
    assert gates.healthy and gates.mrr_ok


def test_cache(spark):
    rows = [(1, "c", "ask", "What  is IT", 10, [1.0, 0.0]), (2, "c", "ask", "what is it", 20, [0.9, 0.1]), (3, "c", "quiz", "what is it", 30, [1.0, 0.0])]
    entries = spark.createDataFrame(rows, "entry_id int, course string, mode string, query string, created int, embedding array<double>")
    queries = spark.createDataFrame([(1, "c", "ask", "WHAT is\nit", [0.0, 1.0]), (2, "c", "ask", "other", [1.0, 0.0]), (3, "d", "ask", "what is it", [1.0, 0.0])], "query_id int, course string, mode string, query string, embedding array<double>")
    assert {r.query_id: (r.entry_id, r.how) for r in cache.lookup(queries, entries).collect()} == {1: (2, "exact"), 2: (1, "nearest")}
    assert {r.mode: r.n for r in cache.stats(entries).collect()} == {"ask": 2, "quiz": 1, "summarize": 0}
    assert [r.entry_id for r in cache.retention(entries, F.lit(25), most=1, ttl=10).orderBy("entry_id").collect()] == [2, 3]


def test_upsert_touches_its_partitions_only(spark):
    writers.create_table(spark, "chunks_test", "chunk_id string, text string, version int, course_id string, namespace string")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string, version int, course_id string, namespace string")
    writers.upsert(spark, "chunks_test", make([("a", "1", 1, "c", "qna"), ("b", "1", 1, "c", "audio")]))
    writers.upsert(spark, "chunks_test", make([("a", "2", 2, "c", "qna"), ("n", "2", 1, "c", "qna"), ("a", "old", 0, "c", "qna")]))
    writers.upsert(spark, "chunks_test", make([("a", "2", 2, "c", "qna")]))
    assert sorted((r.chunk_id, r.text) for r in spark.table("chunks_test").collect()) == [("a", "2"), ("b", "1"), ("n", "2")]
    spark.sql("DROP TABLE chunks_test")


def test_shaping_and_routing(spark):
    df = spark.createDataFrame([("x" * 9000, [1, 2], None, list(map(str, range(40))))], "raw_text string, pages array<int>, year_hint int, questions array<string>")
    r = writers.shaped(df).first()
    assert (len(r.raw_text), r.pages, r.year_hint, len(r.questions)) == (8000, ["1", "2"], -1, 30)
    ups = spark.createDataFrame([("a.PDF", None), ("b.mp3", None), (None, "https://youtu.be/abcdefghijk"), ("c.exe", None), ("d.png", None)], "path string, url string")
    ok, bad = readers.route(ups)
    assert sorted(r.pipeline for r in ok.collect()) == ["audio", "documents", "youtube"] and bad.count() == 2
    tracks = spark.createDataFrame([("v", "en", True), ("v", "de", False), ("v", "fr", False)], "video_id string, language string, is_generated boolean")
    assert readers.preferred_captions(tracks, ["en", "fr"]).first().language == "fr"


EVENTS = [(i, 1 + i % 2, "ask" if i % 3 else "quiz", "student", i * 7.5, (i * 7919) % 20000) for i in range(60)]


def limiter_by_hand():
    out, state = {}, {}
    for i, user, mode, _, at, tokens in EVENTS:
        s = state.setdefault(user, {"recent": [], "level": 80000.0, "last": None, "day": 0})
        s["level"] = min(80000.0, s["level"] + ((at - s["last"]) if s["last"] is not None else 0) * 800.0)
        s["last"] = at
        window = sum(t for m, u, t in s["recent"] if m == mode and u > at - 60)
        reason = "window" if window >= 50000 else "bucket" if s["level"] < 1 else "day" if s["day"] >= 500000 else None
        out[i] = (window, round(s["level"], 3), s["day"], reason)
        s["recent"].append((mode, at, tokens))
        s["level"] = max(0.0, s["level"] - tokens)
        s["day"] += tokens
    return out


def events(spark):
    return spark.createDataFrame(EVENTS, "event_id long, user_id long, mode string, role string, at double, tokens long").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_budget_decisions(spark):
    found = {r.event_id: (r.used_window, round(r.available, 3), r.used_day, r.reason) for r in rate_limit.decisions(events(spark)).collect()}
    assert found == limiter_by_hand()


def test_bucket_over_days(spark):
    import random

    draw = random.Random(9)
    at, rows = 0, []
    for i in range(200):
        at += draw.choice([1, 10, 3600, 40_000])
        rows.append((i, 1 + i % 2, at, draw.randint(0, 90)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, tokens long").withColumn("ts", F.timestamp_seconds("at"))
    found = {r.event_id: round(r.available, 6) for r in rate_limit.bucket_levels(df, 100, 0.01).collect()}
    level, last, expected = {}, {}, {}
    for i, user, at, tokens in rows:
        x = min(100.0, level.get(user, 100.0) + (at - last.get(user, at)) * 0.01)
        expected[i], level[user], last[user] = round(x, 6), max(0.0, x - tokens), at
    assert found == expected


def test_streamed_decisions_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(spark)
    for part in range(3):
        rows.where(f"event_id >= {part * 20} and event_id < {part * 20 + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = rate_limit.stream_decisions(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r.event_id: (r.used_window, round(r.available, 3), r.used_day, r.reason) for r in spark.table("decided").collect()}
    assert found == limiter_by_hand()


def test_streamed_days(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/in")
    last = events(spark).limit(1).withColumn("ts", F.lit("1970-01-03 12:00:00").cast("timestamp"))
    stream = spark.readStream.schema(events(spark).schema).parquet(f"{tmp_path}/in")
    last.write.mode("append").parquet(f"{tmp_path}/in")
    run = rate_limit.stream_daily(stream).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.user_id, int(r.used)) for r in spark.table("days").collect()} == {(u, sum(e[5] for e in EVENTS if e[1] == u)) for u in (1, 2)}


def test_display(spark):
    from ragloom.functions import display

    rows = [("qna", "sheet.pdf", "3", 2021, 5, ["q?"], ["a"]), ("audio", None, None, None, None, None, None), ("other", "f", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, source_file string, page_range string, year_hint int, marks_hint int, questions array<string>, answers array<string>").withColumn("text", F.lit("body")).withColumn("start_label", F.when(F.col("source") == "audio", "01:00")).withColumn("end_label", F.lit("02:00"))
    found = {r.source: (r.citation, r.display_text) for r in display.retrieved(df).collect()}
    assert found == {"qna": ("sheet.pdf · pp. 3 · 2021 · [5 marks]", "Q1: q?\nA1: a"), "audio": ("Lecture · @ 01:00–02:00", "[Lecture @ 01:00–02:00]\nbody"), "other": ("f", "body")}
    assert [r[0] for r in display.wide(df).select(display.search_text()).collect()][0] == "q? a"
    header = display.context_header(F.lit("c1"), F.lit(None).cast("string"), F.lit("T"), F.lit(""), F.lit(2), F.lit(3))
    assert df.select(header).first()[0] == "[c1 | T | Pages 2-3]"
    assert [r.document for r in display.sources(df.withColumn("rank", F.lit(1)), ["source"]).collect()] == ["sheet.pdf", "Course material", "f"]


def test_recognised_pages(spark):
    from ragloom.operators import ocr

    words = [(1, 1, 1, "def", 90.0, 0, 50, 5, 5), (1, 1, 2, "f(x): return x == y;", 80.0, 6, 50, 9, 5), (1, 2, 1, "Title", 96.0, 0, 2, 5, 5), (1, 3, 1, "x", 99.0, 0, 90, 1, 1), (1, 4, 1, "faint words", 20.0, 0, 95, 1, 1), (1, 5, 1, "none", -1.0, 0, 0, 1, 1)]
    df = spark.createDataFrame(words, "page int, block_num int, word_num int, text string, conf double, x int, y int, w int, h int")
    found = ocr.blocks(df, ["page"])
    assert [(r.block_num, r.text, r.w) for r in found.orderBy("reading_order").collect()] == [(2, "Title", 5), (1, "def f(x): return x == y;", 15)]
    page = ocr.pages(found, ["page"]).first()
    assert page.has_code and page.text.startswith("Title\n\n[CODE:") and page.warnings == []
    cheap = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.3), (3, None, None), (4, "d", 0.1)], "page int, text string, confidence double")
    better = spark.createDataFrame([(2, "B", 0.8), (3, "C", 0.7)], "page int, text string, confidence double")
    assert sorted(r.page for r in ocr.to_escalate(cheap).collect()) == [2, 3, 4]
    assert sorted((r.page, r.text, r.model) for r in ocr.escalated(cheap, better, ["page"]).collect()) == [(1, "a", "flash"), (2, "B", "pro"), (3, "C", "pro"), (4, "d", "flash")]
    assert ocr.full_text(cheap.withColumn("doc", F.lit(1)), "doc").first().text == "[Page 1]\na\n\n[Page 2]\nb\n\n[Page 4]\nd"
    kinds = spark.createDataFrame([("Head", 1), ("- item", 50), ("Figure 2", 95), ("a = b < c", 50), ("text", 50), ("", 50)], "t string, y int")
    assert [r[0] for r in kinds.select(ocr.block_type(F.col("t"), F.col("y"), F.lit(100))).collect()] == ["heading", "list_item", "caption", "formula", "paragraph", "unknown"]


def test_source_rates(spark):
    df = spark.createDataFrame([("Unknown", "l", True), ("One", "", None)], "chapter_title string, deep_link string, is_generated_transcript boolean")
    r = metrics.source_rates(df, "youtube").first()
    assert (r.n, r.chapter_rate, r.deep_link_rate, r.manual_rate) == (2, 0.5, 0.5, 0.0)
    assert metrics.temporal_coverage(spark.createDataFrame([(1, 50.0, 100.0)], "k int, e double, d double"), ["k"], "e", "d").first().coverage == 0.5


def test_more_chunkers(spark):
    from ragloom.operators import ocr

    pages = spark.createDataFrame([(1, "a b\n\nc"), (2, "one\ntwo.\nthree"), (3, ""), (4, None)], "p int, text string")
    assert sorted((r.p, r.at, r.text) for r in chunking.paragraphs(pages, ["p"]).collect()) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "one two."), (2, 1, "three")]
    marked = spark.createDataFrame([(1, "# T\n\n## H\n\n$$x$$\n\n|a|\n\n[diagram: d]\n\ntext")], "p int, text string")
    assert [(r.kind, r.content) for r in chunking.markdown_elements(marked, ["p"]).orderBy("at").collect()] == [("Title", "T"), ("Heading", "H"), ("Equation", "$$x$$"), ("Table", "|a|"), ("Diagram", "[diagram: d]"), ("Paragraph", "text")]
    assert values(spark, lambda t: ocr.clean_text(t, code=True), "\n  x|y = “1” \n\n") == ['  xly = "1"']
    assert values(spark, ocr.clean_text, "T he  ﬁrst com-\nputer ", None) == ["The first com-\nputer", None] or values(spark, ocr.clean_text, "T he  ﬁrst", None) == ["The first", None]
    segments = spark.createDataFrame([(1, 0, i, f"wave part {i}", float(i), i + 1.0, 0.5 + i / 10, i == 2, ["light", "wave"]) for i in range(3)], "l int, chunk int, seg int, text string, start double, end double, confidence double, is_unclear boolean, topics array<string>")
    r = chunking.audio_chunks(segments, ["l"], "chunk", "seg").first()
    assert (r.text, r.word_count, r.avg_confidence, r.min_confidence, r.has_unclear_segments, r.concepts, r.concept_label) == ("wave part 0 wave part 1 wave part 2", 9, 0.6, 0.5, True, ["wave"], "wave")
    words = [" ".join(f"w{i}_{k}" + ("." if k == 9 else "") for k in range(20)) for i in range(40)]
    captions = spark.createDataFrame([(1, float(i), t) for i, t in enumerate(words)], "v int, start double, text string")
    kept = [w for r in chunking.timed_captions(captions, "v", lossless=True).orderBy("chunk_index").collect() for w in r.text.split()]
    assert kept == " ".join(words).split()
    assert chunking.timed_captions(captions, "v").count() >= 2
    units = spark.createDataFrame([(1, 0, "Alpha beta", 80.0, ["w"], ["s"], 1), (1, 1, "alpha 12", 0.0, ["w"], [], 2)], "k int, at int, text string, confidence double, warnings array<string>, stages array<string>, page int")
    m = chunking.window_metadata(units, ["k"]).first()
    assert (m.word_count, m.semantic_density, m.confidence, m.warnings, m.page_numbers) == (4, 0.5, 80.0, ["w"], [1, 2])
