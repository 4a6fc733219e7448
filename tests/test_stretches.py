"""Ordered work by stretches against plain loops, with a hot key, null keys and ties."""

import random
from statistics import median

from pyspark.sql import functions as F

from ragloom.operators import chunking, stretches


def rows(n=900):
    rng = random.Random(7)
    out = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, f"t{i}", rng.random() < 0.05) for i in range(n)]
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc string, at int, text string, mark boolean").repartition(5)


def test_carried_and_placed_equal_a_plain_loop(spark):
    data = rows()
    value = F.when(F.col("mark"), F.col("text"))
    carried = {(r.doc, r.at): r.last for r in stretches.carried(frame(spark, data), ["doc"], ["at"], value, "last").collect()}
    placed = {(r.doc, r.at): (r["__at"], r["__n"]) for r in stretches.placed(frame(spark, data), ["doc"], ["at"]).collect()}
    assert len(carried) == len(placed) == len(data)
    for doc in {d for d, *_ in data}:
        own = sorted(r[1:] for r in data if r[0] == doc)
        last = None
        for i, (at, text, mark) in enumerate(own):
            last = text if mark else last
            assert carried[doc, at] == last and placed[doc, at] == (i, len(own))


def test_no_stretch_of_a_hot_key_is_long(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # so few bytes would be one stretch
    try:
        held = stretches.dealt(frame(spark, rows(3000)), ["doc"], ["at"])
    finally:
        spark.conf.unset(name)
    sizes = [r["count"] for r in held.groupBy("__part").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * median(sizes)


def test_chapters_of_a_hot_video(spark):
    rng = random.Random(2)
    snippets = [("v" if i % 4 else "w", float(rng.randint(0, 500)) if i % 50 else None, i) for i in range(600)]
    chapters = [("v", 100.0 * k + 37, f"c{k}") for k in range(4)] + [("x", 0.0, "other")]
    found = chunking.as_of_chapter(spark.createDataFrame(snippets, "video string, at double, id int"), spark.createDataFrame(chapters, "video string, chapter_start double, title string"), "video", "at").collect()
    own = [(s, t) for v, s, t in chapters if v == "v"]
    for r in found:
        k = max([i for i, (s, _) in enumerate(own) if r.at is not None and s <= r.at], default=0)
        assert (r.chapter, r.chapter_index) == ((own[k][1], k) if r.video == "v" else ("Unknown", -1))
    assert len(found) == 600


def test_repeats_of_a_text_keep_the_first(spark):
    data = [("d", i, " same " if i % 2 else f"text {i}", f"id{i}") for i in range(40)] + [(None, 3, "same", "n")]
    found = chunking.post_process(spark.createDataFrame(data, "doc string, at int, text string, chunk_id string"), "doc", "at").collect()
    assert sorted(r.at for r in found if r.doc == "d") == [0, 1, *range(2, 40, 2)] and sum(r.doc is None for r in found) == 1
    assert {r.total_chunks for r in found if r.doc == "d"} == {21}


def test_no_rows(spark):
    none = frame(spark, rows(3)).limit(0)
    assert stretches.carried(none, ["doc"], ["at"], F.col("text"), "x").collect() == [] == stretches.placed(none, ["doc"], ["at"]).collect()


def test_packers_stream_a_document_of_any_length(spark):
    """A million elements of one document: the task gives its chunks while it reads, and they are those of the fold over a list."""
    n = 1_000_000
    kind = F.when(F.col("id") % 5000 == 0, "Title").when(F.col("id") % 997 == 0, "Table").otherwise("Paragraph")
    big = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("at"), kind.alias("kind"), F.concat(F.lit("Text of "), F.col("id").cast("string"), F.lit(".")).alias("content"), F.lit(1).alias("page"))
    found = chunking.element_chunks(big, "doc")
    total = found.agg(F.count("*"), F.sum(F.length("text")), F.countDistinct("title"), F.max("chunk_index")).first()
    assert total[0] == total[3] + 1 and total[1] > 15 * n and total[2] == 200
    held, most = 0, 0
    rows = ((f"paragraph number {i}",) for i in range(200_000))
    for w in chunking.packed_words((t for (t,) in rows), 400, 60):
        held += 1
        most = max(most, len(w))
    assert held > 1000 and most < 400


def test_a_packer_reads_no_further_than_it_gives():
    read = []

    def elements():
        for i in range(10_000):
            read.append(i)
            yield ("Title" if i % 50 == 0 else "Text", f"element {i}", 1)

    first = next(chunking.sections(elements()))
    assert first and len(read) < 500


def test_windows_of_texts_are_sent_on_at_a_bound(spark, monkeypatch):
    texts = [None, "", "\n".join(f"a{i} b. c" for i in range(900)), "x " * 700, "one\ntwo"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    expected = [(i, k, " ".join(w), len(w)) for i, t in enumerate(texts) for k, w in enumerate(chunking.packed_words((t or "").split("\n")))]
    for limit in (1, 5000, 1 << 20):
        monkeypatch.setattr(chunking, "WINDOW_CHARS", limit)
        found = chunking.text_windows(docs, "doc_id")
        assert [tuple(r) for r in found.collect()] == expected
    assert len(expected) > 8
