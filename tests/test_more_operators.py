"""Chunks of sections, transcripts, office files, dumps, numbering and folds on rows worked out by hand or by plain Python."""

import collections
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom.operators import cache, chunking, keywords, metrics, ranking, vectors
from ragloom.sources import readers, writers


def test_sections_are_packed_by_titles_and_sizes():
    parts = lambda *e, **s: [[t for _, t in c] for c in chunking.section_parts([k for k, _ in e], [t for _, t in e], **s)]
    sizes = {"most": 60, "soft": 40, "combine": 20, "overlap": 10}
    assert parts(("Title", "One"), ("T", "a" * 30), ("T", "b" * 15), ("T", "c" * 20), **sizes) == [["One", "a" * 30, "b" * 15], ["c" * 20]]
    assert parts(("Title", "One"), ("T", "short"), ("Title", "Two"), ("T", "text"), ("Title", "Three"), ("T", "x" * 45), **sizes) == [["One", "short", "Two", "text"], ["Three", "x" * 45]]
    long = " ".join(f"w{i:02}" for i in range(40))
    cut = parts(("T", "before"), ("T", long), ("T", "after"), **sizes)
    assert cut[0] == ["before"] and cut[-1] == ["after"] and all(len(t) <= 60 for c in cut for t in c)
    assert all(a[0][-10:] == b[0][:10] for a, b in zip(cut[1:-2], cut[2:-1]))
    words = [w for c in cut[1:-1] for w in c[0].split()]
    assert set(words) >= set(long.split()) and parts(**sizes) == [] and parts(("T", ""), **sizes) == []
    assert parts(("T", "y" * 130), **sizes)[0] == ["y" * 60]


def test_title_chunks_make_documents(spark):
    rows = [(1, 0, "Title", "Head", 1), (1, 1, "NarrativeText", "Body one.", 1), (1, 2, "Table", "a b", 2), (1, 3, "Title", "Next", None), (1, 4, "NarrativeText", "z" * 600, 3), (2, 0, "NarrativeText", None, 1)]
    elements = spark.createDataFrame(rows, "doc int, at int, kind string, text string, page int")
    made = chunking.document_chunks(chunking.title_chunks(elements, "doc", combine=0), "doc").orderBy("chunk").collect()
    assert [(r.doc, r.section_title, r.raw_text, r.tables_text, r.page_start, r.page_end) for r in made] == [(1, "Head", "Head\nBody one.", "a b", 1, 2), (1, "Next", "Next\n" + "z" * 600, "", 3, 3)]


def test_transcripts_go_by_chapters_or_by_time(spark):
    snippets = [(v, float(i), " ".join(f"v{v}w{i}_{k}" for k in range(30))) for v in (1, 2) for i in range(20)]
    marks = [(1, 0.0, "one"), (1, 10.0, "two")]
    found = chunking.transcript_chunks(spark.createDataFrame(snippets, "v int, start double, text string"), spark.createDataFrame(marks, "v int, chapter_start double, title string"), "v", most=100, overlap=0).collect()
    for v in (1, 2):
        own = sorted((r for r in found if r.v == v), key=lambda r: r.chunk_index)
        assert [w for r in own for w in r.text.split()] == [w for a, _, t in snippets for w in t.split() if a == v]
        assert {r.chapter for r in own} == ({"one", "two"} if v == 1 else {None})


def windows_by_loop(texts, least, most, overlap=60):
    out = []
    for text in texts:
        n = len(text.split())
        size = lambda k: max(1, int(k * 1.3))
        if out and size(n) < 2 * least and size(out[-1][1] + n) <= most + overlap:
            out[-1] = (out[-1][0] + "\n\n" + text, out[-1][1] + n)
        else:
            out.append((text, n))
    return out


def test_tiny_windows_join_the_one_before(spark):
    draw = random.Random(4)
    docs = {d: [" ".join("w" for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(1, 12))] for d in range(20)}
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    found = chunking.merged_windows(spark.createDataFrame(rows, "d int, at int, text string"), "d", "at", 20, 50)
    own = collections.defaultdict(list)
    for r in found.orderBy("d", "window").collect():
        own[r.d].append((r.text, r.n_words))
    assert own == {d: windows_by_loop(texts, 20, 50) for d, texts in docs.items()}


def office(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def test_office_files_are_read_and_bad_ones_rejected(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    paragraphs = "".join(f"<w:p><w:r><w:t>p{i}</w:t></w:r><w:r><w:t> é&amp;</w:t></w:r></w:p>" for i in range(60)) + "<w:p></w:p>"
    docx = office({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{paragraphs}</w:body></w:document>'})
    slide = lambda *t: f'<p:sld xmlns:p="urn:p" xmlns:a="{a}">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    pptx = office({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two", "more", " "), "ppt/other.xml": "<x/>"})
    files = [("a.DOCX", docx), ("b.pptx", pptx), ("c.txt", "plain é".encode()), ("d.docx", b"no zip"), ("e.exe", b""), (None, None), ("f.pdf", b"%PDF")]
    df = spark.createDataFrame(files, "path string, content binary").withColumn("length", F.lit("clash"))
    rows = collections.defaultdict(list)
    for r in readers.file_pages(df, {"pdf": lambda data: ["one", "two"]}).collect():
        rows[r.path].append((r.page, r.text, r.error and r.error.split(":")[0]))
    first = sorted(rows["a.DOCX"])
    assert [p for p, _, _ in first] == [1, 2] and first[0][1].split("\n")[:2] == ["p0 é&", "p1 é&"] and len(first[1][1].split("\n")) == 10
    assert sorted(rows["b.pptx"]) == [(1, "two\nmore", None), (2, "ten", None)] and rows["c.txt"] == [(1, "plain é", None)] and sorted(rows["f.pdf"]) == [(1, "one", None), (2, "two", None)]
    assert rows["d.docx"] == [(None, None, "BadZipFile")] and rows["e.exe"] == rows[None] == [(None, None, "ValueError")]
    assert readers.file_pages(df.limit(0)).collect() == []


def test_dump_rejects_whole_files(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "1", None), ("a", "2", None), ("b", "3", "bad"), ("b", "4", None)], "source_file string, text string, error string")
    bad = writers.chunk_dump(chunks, str(tmp_path / "out")).collect()
    assert [(r.source_file, r.error) for r in bad] == [("b", "bad")]
    assert sorted((r.source_file, r.text) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("a", "1"), ("a", "2")]


def test_fixtures_fill_missing_fields(spark):
    assert [tuple(r) for r in readers.fixtures(spark, [{"a": 1}, {"b": "x", "a": 2}], "a int, b string").orderBy("a").collect()] == [(1, None), (2, "x")]


def test_numbering_by_ranges_equals_a_plain_loop(spark):
    rows = [(d, o, f"c{d}_{o}") for d in (1, 2, None) for o in range(300 if d == 1 else 7)]
    random.Random(2).shuffle(rows)
    found = chunking.numbered(spark.createDataFrame(rows, "doc int, at int, chunk_id string").repartition(5), "doc", "at", "chunk_id").collect()
    assert len(found) == len(rows)
    for r in found:
        n = 300 if r.doc == 1 else 7
        assert (r.chunk_index, r.total_chunks) == (r.at, n)
        assert r.prev_chunk_id == (f"c{r.doc}_{r.at - 1}" if r.at else None) and r.next_chunk_id == (f"c{r.doc}_{r.at + 1}" if r.at + 1 < n else None)


def test_clusters_stream_in_order_whatever_the_length(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    rows = [(d, i, [float(x) for x in draw.normal(size=3)]) for d in range(3) for i in range(200)]
    found = {(r.d, r.i): r.cluster for r in vectors.sequential_clusters(spark.createDataFrame(rows, "d int, i int, embedding array<double>").repartition(4), "d", "i", threshold=0.6).collect()}
    for d in range(3):
        centres, sizes = [], []
        for _, i, v in (r for r in rows if r[0] == d):
            v = np.array(v)
            near = [(float(centres[c] @ v) / (np.linalg.norm(centres[c]) * np.linalg.norm(v)), -c) for c in range(max(0, len(centres) - 5), len(centres))]
            if near and max(near)[0] >= 0.6:
                c = -max(near)[1]
                sizes[c] += 1
                centres[c] = centres[c] + (v - centres[c]) / sizes[c]
            else:
                c = len(centres)
                centres.append(v)
                sizes.append(1)
            assert found[d, i] == c


def test_top_k_in_shuffled_blocks_equals_that_of_sent_ones(spark, monkeypatch):
    rows = [(i, [float((i * 37) % 11), float((i * 17) % 7), 1.0], i % 3) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>, part int")
    queries = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    sent = sorted(map(tuple, vectors.dense_top_k(queries, chunks, 4, by=["part"]).collect()))
    monkeypatch.setattr(vectors, "MOST_SENT", 0)
    assert sorted(map(tuple, vectors.dense_top_k(queries, chunks, 4, by=["part"]).collect())) == sent and len(sent) == 20 * 3 * 4
    with_null = chunks.unionByName(spark.createDataFrame([(999, None, 0)], chunks.schema))
    assert sorted(map(tuple, vectors.dense_top_k(queries, with_null, 4, by=["part"]).collect())) == sent


def test_ideals_from_counts_equal_those_of_lists(spark):
    draw = random.Random(8)
    ranked = [(q, c, r + 1, 1.0 / (r + 1)) for q in range(6) for r, c in enumerate(draw.sample(range(40), 15))]
    grades = [(q, c, draw.randint(0, 3)) for q in range(5) for c in draw.sample(range(40), 20)]
    lists, graded = spark.createDataFrame(ranked, "q int, chunk_id int, rank int, score double"), spark.createDataFrame(grades, "q int, chunk_id int, grade int")
    for linear in (False, True):
        gain = (lambda g: g) if linear else (lambda g: 2**g - 1)
        import math

        for r in metrics.retrieval(lists, graded, ["q"], 10, linear=linear).collect():
            own = {c: g for q, c, g in grades if q == r.q}
            dcg = sum(gain(own.get(c, 0)) / math.log2(k + 1) for q, c, k, _ in ranked if q == r.q and k <= 10)
            ideal = sum(gain(g) / math.log2(k + 2) for k, g in enumerate(sorted(own.values(), reverse=True)[:10]))
            assert r.ndcg == pytest.approx(dcg / ideal if ideal else 0)


def test_keywords_of_a_row_are_those_of_a_group(spark):
    texts = ["", None, "alpha beta alpha gamma beta alpha", "zeta " * 3 + "eta zeta theta theta", "the and with"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = {r.doc_id: r.keywords for r in keywords.top_terms(df, ["doc_id"], "text", "[a-z]{4,}", keywords.tx.KEYWORD_STOPWORDS, 12).collect()}
    assert {r.doc_id: r.keywords for r in keywords.document_keywords(df).collect()} == plain and plain[2] == "alpha, beta, gamma"


def test_keywords_of_a_row_are_counted_not_sorted(spark, monkeypatch):
    """Plain counting of odd and long texts gives the same, pieces of any size included; no occurrence is sorted or shuffled."""
    draw = random.Random(5)
    pool = ["".join(draw.choices("abc", k=draw.choice([1, 3, 4, 5]))) for _ in range(60)] + ["ABCD", "\u0130abcd", "\u212aelvin", "abcd\u00e9", "a\0bcde", "from", "\U0001f600", "ab-cd_e"]
    texts = ["", None, "\0", "from these", "abcd", " abcd\0", "zeta" * 5000, *(draw.choice([" ", "\n", "\0"]).join(draw.choices(pool, k=n)) for n in (1, 2, 13, 50, 400, 3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    wanted = {}
    for i, text in enumerate(texts):
        found = [t for t in re.findall("[a-z]{4,}", (text or "").lower()) if t not in keywords.tx.KEYWORD_STOPWORDS]
        wanted[i] = ", ".join(sorted(dict.fromkeys(found), key=lambda t: -found.count(t))[:12])  # noqa: B023
    made = keywords.document_keywords(df)
    assert {r.doc_id: r.keywords for r in made.collect()} == wanted
    for plan in (made, keywords.caption_tags(df, "doc_id")):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "sort" not in shown.lower() and "exchange" not in shown.lower() and "lambda" not in shown
    for step in (0, 1, 7):
        monkeypatch.setattr(keywords, "PIECE_CHARS", step)
        assert {r.doc_id: r.keywords for r in keywords.document_keywords(df).collect()} == wanted


def test_terms_of_a_row_keep_its_columns_and_the_pattern_of_the_jvm(spark):
    df = spark.createDataFrame([(1, "na\u00efve na\u00efve \u00fcber \u00bdabcd x\u0301abcd", [1], None)], "id int, text string, other array<int>, none string")
    assert [tuple(r) for r in keywords.row_terms(df, "text", r"\p{L}{4,}", ["\u00fcber"], 2, " / ", "t").collect()] == [(1, df.first().text, [1], None, "na\u00efve / abcd")]
    wide = keywords.row_terms(df, "text", "[a-z]*", [], 50, "|", "t").first().t.split("|")
    assert sorted(wide) == sorted({"", "na", "ve", "ber", "abcd", "x"})
    assert keywords.row_terms(df, "none", "[a-z]+", [], 5, out="t").first().t == ""


def test_zip_demands_equal_ids(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    good = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    assert {r.chunk_id: r.embedding for r in chunking.zipped(chunks, good).collect()} == {"a": [1.0], "b": [2.0]}
    for bad in (good.limit(1), good.union(spark.createDataFrame([("c", [3.0])], good.schema))):
        with pytest.raises(Exception, match="same ids"):
            chunking.zipped(chunks, bad).collect()


def test_rehydrated_chunks_have_defaults(spark):
    entries = spark.createDataFrame([("e", '[{"chunk_id":"c","display_text":"t"},{"chunk_id":"d","rank":7,"score":0.5,"source":"qna"}]'), ("n", None)], "entry_id string, chunks string")
    hits = spark.createDataFrame([(1, "e"), (2, "n")], "query_id int, entry_id string")
    assert sorted(tuple(r) for r in cache.rehydrated(hits, entries).collect()) == [(1, "c", "documents", 0.0, 1, "t", ""), (1, "d", "qna", 0.5, 7, "", "")]


def test_bm25_of_empty_and_tied_groups(spark):
    rows = [(1, "x y", "c1", 1, None), (1, "x y", "c2", 2, ""), (2, "", "c1", 1, "alpha beta"), (3, "alpha", "c1", 1, "alpha"), (3, "alpha", "c2", 2, "alpha beta"), (3, "alpha", "c3", 3, "gamma delta")]
    found = {(r.q, r.chunk_id): (r.bm25, r.bm25_rank) for r in ranking.bm25(spark.createDataFrame(rows, "q int, query string, chunk_id string, rank int, text string"), ["q"]).collect()}
    assert found[1, "c1"] == (0.0, 1) and found[1, "c2"] == (0.0, 2) and found[2, "c1"] == (0.0, 1) and len(found) == 6


def test_code_is_told_by_all_signs_though_few_are_sought(spark):
    from ragloom.operators import ocr

    needed = lambda p: ocr.needed(ocr.sre.parse(p))
    assert needed(r"\bif\s+__name__\s*==") == [["if"], ["__name__"], ["=="]] and needed(r"\bEND\b|A[xy]") == [["end", "a"]] and needed(r"[;{]\w+(a|\d)") == [[";", "{"]]
    texts = [
        None, "", "plain words only", "DEF f (x):\n  RETURN x;", "public static void main(String[] a) {\n  System.out.println(1);\n}", "#include <a>\nstd::cout << 1; a->b",
        "select a\nfrom b", "SELECT a FROM b WHERE c JOIN d", "if a then\nEND while x do y\n←", "const x = 1; let y = () => { z === 1 }", "#!/bin/sh\necho $a | cat && \n \\\n", "int *p; printf (\"a\"); malloc (3)", "\u212aelvin İF THEN ıf",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = F.coalesce("text", F.lit(""))
    counts = {lang: ocr.count(whole, p, "im").alias(lang) for lang, p in ocr.LANGUAGE_SIGNS.items()}
    rows = df.select("id", ocr.looks_like_code(F.col("text")).alias("code"), ocr.code_language(F.col("text")).alias("language"), (ocr.count(whole, ocr.CODE_SIGNS, "m") >= 3).alias("plain"), *counts.values()).collect()
    for r in rows:
        best = max(counts, key=lambda lang: r[lang])
        assert (r["code"], r["language"]) == (r["plain"], best if r[best] >= 2 else "unknown")
    assert len({r["language"] for r in rows}) >= 6
