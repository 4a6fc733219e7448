"""Chunking of transcripts, question sheets, elements, pages and captions.

Window and block chunkers are joins, windows and aggregates.  The packers, whose next cut hangs on
the last one, are folds over a document's rows in order, which stream through their task.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ragloom.functions import text as tx
from ragloom.operators import stretches
from ragloom.sources.writers import staged

# Sizes of the element chunker in characters.
SOFT, HARD, OVERLAP, TINY = 1500, 2500, 120, 80
STANDALONE, HEADINGS = ("Diagram", "Table"), ("Title", "Heading")


# --- transcripts -----------------------------------------------------------------------------

def ordered(columns: list[str], order: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def sliding_windows(segments: DataFrame, keys: list[str], order: str, size: int = 6, overlap: int = 2, text: str = "text") -> DataFrame:
    """keys, window_index, first, last, n_segments, text, overlap_prev and overlap_next of every window.

    Windows begin every size - overlap segments and end with the one that reaches the last segment.  A
    segment knows from its place which windows hold it, so it is sent to these alone.
    """
    step = max(1, size - overlap)
    rows = segments.select(*keys, F.col(text).alias("__text"), F.col(order).alias("__order"))
    placed = stretches.placed(rows, keys, ["__order"])
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / step)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("__at") - size + 1) / step)).cast("int")
    high = F.least(last, F.floor(F.col("__at") / step)).cast("int")
    dealt = placed.where(low <= high).select("*", last.alias("__last"), F.explode(F.sequence(low, high)).alias("window_index"))
    chunks = dealt.groupBy(*keys, "window_index", "__last").agg(
        F.min("__at").cast("int").alias("first"), F.max("__at").cast("int").alias("last"), F.count("*").alias("n_segments"),
        F.array_join(F.transform(ordered(["__text"], "__at"), lambda s: F.coalesce(s["__text"], F.lit(""))), " ").alias("text"))
    at = F.col("window_index")
    return chunks.withColumn("overlap_prev", F.when(at == 0, 0).otherwise(overlap)).withColumn("overlap_next", F.when(at == F.col("__last"), 0).otherwise(overlap)).drop("__last")


def concept_blocks(segments: DataFrame, keys: list[str], order: str, topics: str = "topics", least: int = 4, most: int = 12, text: str = "text") -> DataFrame:
    """keys, block, first, last, n_segments, topic and text of blocks that follow the leading topic.

    At each segment the leading topic is the one named most often in it and the next ones
    (max(3, least) together); a block ends where it changes, after ``least`` segments, and at
    ``most`` in any case.  Without topics a block ends every ``least`` segments.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    ahead = F.lower(F.array_join(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(own.rowsBetween(0, max(3, least) - 1)), " "))
    named = lambda t: (F.length("ahead") - F.length(F.replace(F.col("ahead"), F.lower(t), F.lit("")))) / F.greatest(F.length(t), F.lit(1))
    scored = F.transform(F.coalesce(F.col(topics), F.array().cast("array<string>")), lambda t, i: F.struct(named(t).alias("n"), (-i).alias("at"), t.alias("topic")))
    best = F.array_max(scored)
    leading = F.when(F.size(scored) == 0, F.lit(None)).when(best["n"] > 0, best["topic"])
    seen = segments.withColumn("ahead", ahead).withColumn("leading", leading).withColumn("__place", F.row_number().over(own) - 1)
    packed = seen.groupBy(*keys).agg(ordered(["leading", text], "__place").alias("rows"), F.max(F.size(F.coalesce(F.col(topics), F.array().cast("array<string>")))).alias("n_topics"))
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("count"), F.lit(None).cast("string").alias("topic"), F.array().cast("array<int>").alias("blocks"))

    def fold(state: Column, row: Column) -> Column:
        change = F.when(F.col("n_topics") == 0, state["count"] >= least).otherwise(
            (state["count"] >= least) & row["leading"].isNotNull() & ~F.coalesce(row["leading"] == state["topic"], F.lit(False)) & state["topic"].isNotNull())
        cut = change | (state["count"] >= most)
        block = F.when(cut, state["block"] + 1).otherwise(state["block"])
        return F.struct(block.alias("block"), F.when(cut, 1).otherwise(state["count"] + 1).alias("count"), F.coalesce(row["leading"], state["topic"]).alias("topic"), F.array_append(state["blocks"], block).alias("blocks"))

    blocks = F.aggregate("rows", start, fold, lambda s: s["blocks"])
    flat = packed.withColumn("blocks", blocks).select(*keys, "blocks", F.posexplode("rows").alias("i", "row")).select(*keys, F.get("blocks", F.col("i")).alias("block"), "row")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda s: F.coalesce(s[text], F.lit(""))), " ")
    return flat.groupBy(*keys, "block").agg(F.min("row.__place").alias("first"), F.max("row.__place").alias("last"), F.count("*").alias("n_segments"), F.mode("row.leading", True).alias("topic"), joined.alias("text"))


def lecture_summary(lectures: DataFrame, summary: str = "summary", topics: str = "topics", terms: str = "key_terms") -> DataFrame:
    """Append ``text``: summary, topics as bullets, and key terms; what is empty is left out."""
    bullets = F.when(F.size(topics) > 0, F.concat(F.lit("Topics covered:\n"), F.array_join(F.transform(topics, lambda t: F.concat(F.lit("- "), t)), "\n")))
    words = F.when(F.size(terms) > 0, F.concat(F.lit("Key terms: "), F.array_join(terms, ", ")))
    return lectures.withColumn("text", F.concat_ws("\n\n", F.nullif(F.trim(summary), F.lit("")), bullets, words))


def as_of_chapter(snippets: DataFrame, chapters: DataFrame, key: str, at: str, start: str = "chapter_start", title: str = "title") -> DataFrame:
    """Append chapter and chapter_index: the last chapter that has begun, before the first one the first, without chapters ("Unknown", -1).

    Chapters are carried forward over the snippets of their video, stretch by stretch; nothing is joined by all pairs.
    """
    marks = chapters.select(key, start, F.col(title).alias("chapter"), (F.row_number().over(Window.partitionBy(key).orderBy(start)) - 1).alias("chapter_index"))
    none = F.lit(float("-inf"))  # the first chapter is there for what comes before it, too
    tagged = snippets.select(F.struct(*snippets.columns).alias("row"), F.col(key).alias(key), F.coalesce(F.col(at).cast("double"), none).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<chapter:string,chapter_index:int>").alias("mark"))
    begins = F.when(F.col("chapter_index") == 0, none).otherwise(F.col(start).cast("double"))
    begun = marks.select(F.lit(None).cast(tagged.schema["row"].dataType).alias("row"), key, begins.alias("t"), F.lit(0).alias("kind"), F.struct(F.col("chapter").cast("string").alias("chapter"), "chapter_index").alias("mark"))
    found = stretches.carried(tagged.unionByName(begun), [key], ["t", "kind"], F.col("mark"), "last").where("kind = 1")
    return found.select("row.*", F.coalesce("last.chapter", F.lit("Unknown")).alias("chapter"), F.coalesce("last.chapter_index", F.lit(-1)).alias("chapter_index"))


# --- questions -------------------------------------------------------------------------------

# What begins a question, an answer and a solution at the start of a line.
QUESTION = (
    r"(?im)^(?:Q\.?\s*)?(?:\d+)[.)]\s+|^(?:Q\.?\s*)?(?:x{0,3}(?:ix|iv|v?i{0,3}))[.)]\s+|^(?:Question|Ques|Q)\s*[:\-–—]?\s*\d*\s*[:\-–—]?\s+|^\s*\(?(?:[a-z])\)?[.)]\s+"
)
ANSWER = (r"(?im)^(?:Answer|Ans|A)\s*[:\-–—]?\s*\d*\s*[:\-–—]?\s+", r"(?im)^Solution\s*[:\-–—]\s+")


def question_blocks(pages: DataFrame, doc: str, page: str = "page", text: str = "text", least: int = 15, lossless: bool = True) -> DataFrame:
    """doc, block, text, page_start and page_end of stretches that begin like a question.

    Text before the first beginning is a block too.  A document without beginnings falls apart at blank lines.
    Not ``lossless``: that text is dropped, and so are stretches under ``least`` characters (20 without beginnings).
    """
    joined = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), tx.cleaned(F.col(text)).alias("text")))).alias("pages"))
    whole = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    cut = F.split(F.regexp_replace(F.col("whole"), QUESTION, "\x01$0"), "\x01")
    asked = F.size("cut") > 1
    parts = F.when(asked, F.col("cut") if lossless else F.slice("cut", 2, F.greatest(F.size("cut") - 1, F.lit(0)))).otherwise(F.split("whole", r"\n\s*\n"))
    skipped = F.when(asked & F.lit(not lossless), F.length(F.get("cut", F.lit(0)))).otherwise(0)
    split = joined.withColumn("whole", whole).withColumn("cut", cut).select(doc, "pages", asked.alias("asked"), parts.alias("parts"), skipped.alias("skipped"))
    # Where a part begins: after all before it (blank lines, if they parted them, count as two).
    sizes = F.transform("parts", lambda p: F.length(p) + F.when(F.col("asked"), 0).otherwise(2))
    offset = lambda i: F.col("skipped") + F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b)
    ends = F.transform("pages", lambda p, i: F.struct(F.aggregate(F.slice("pages", 1, i + 1), F.lit(0), lambda a, q: a + F.length(q["text"]) + 1).alias("end"), p["page"].alias("page")))
    rows = split.withColumn("sizes", sizes).withColumn("ends", ends).select("*", F.posexplode("parts").alias("i", "part"))
    page_at = lambda place: F.coalesce(F.get(F.filter("ends", lambda e: e["end"] > place), F.lit(0))["page"], F.element_at("ends", -1)["page"])
    begin = offset(F.col("i"))
    kept = rows.select(doc, "i", F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")).alias("text"), page_at(begin).alias("page_start"), page_at(begin + F.greatest(F.length("part") - 1, F.lit(0))).alias("page_end"), F.lit(1).alias("least") if lossless else F.when(F.col("asked"), least).otherwise(20).alias("least"))
    kept = kept.where(F.length("text") >= F.col("least"))
    return kept.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("i")) - 1).alias("block"), "text", "page_start", "page_end")


def parsed_block(text: Column) -> dict[str, Column]:
    """question, answer and hints of a block; without a marker the whole text is the question."""
    first = F.regexp_instr(text, F.lit(ANSWER[0]))
    second = F.regexp_instr(text, F.lit(ANSWER[1]))
    at = F.when(first > 0, first).otherwise(second)
    question = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    answer = F.when(at > 0, F.regexp_replace(F.substring(text, at, F.length(text)), F.when(first > 0, F.lit(ANSWER[0])).otherwise(F.lit(ANSWER[1])), F.lit("")))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return {"question": strip(question), "answer": strip(answer), "difficulty_hint": tx.difficulty(text), "marks_hint": tx.marks(text), "year_hint": tx.year(text), "has_sub_parts": tx.has_sub_parts(text)}


def qna_chunks(blocks: DataFrame, doc: str, most: int = 800) -> DataFrame:
    """Chunks of the blocks of each (doc, cluster): doc, cluster, half, chunk_type, texts, hints and pages.

    Needs block, cluster, text, page_start, page_end and the columns of parsed_block().  A cluster
    over ``most`` estimated tokens with several blocks is halved once; its halves keep its hints.
    """
    own = Window.partitionBy(doc, "cluster")
    sized = blocks.withColumn("n", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("block")) - 1).withColumn("tokens", F.floor(F.sum(F.length("text")).over(own) / 4))
    levels = blocks.where("difficulty_hint is not null").groupBy(doc, "cluster", "difficulty_hint").agg(F.count("*").alias("c"))
    modal = levels.withColumn("r", F.row_number().over(own.orderBy(F.desc("c"), "difficulty_hint"))).where("r = 1").select(doc, "cluster", F.col("difficulty_hint").alias("difficulty"))
    shared = blocks.groupBy(doc, "cluster").agg(F.floor(F.avg("marks_hint")).cast("int").alias("marks"), F.max("year_hint").alias("year"))
    halved = (F.col("tokens") > most) & (F.col("n") > 1)
    half = F.when(halved & (F.col("at") >= F.floor(F.col("n") / 2)), 1).otherwise(0)
    texts = lambda c: F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(c, F.lit("")).alias("t")))), lambda s: s["t"]), lambda t: t != "")
    chunks = sized.withColumn("half", half).withColumn("halved", halved).groupBy(doc, "cluster", "half").agg(
        texts(F.col("question")).alias("questions"), texts(F.col("answer")).alias("answers"), F.array_join(texts(F.col("text")), "\n\n").alias("raw_text"), F.count("*").alias("n_blocks"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.max("has_sub_parts").alias("has_sub_parts"), F.max("halved").alias("halved"))
    kind = F.when(F.size("questions") > 1, "multi_qa").when(F.col("halved") | (F.size("answers") > 0), "single_qa").otherwise("passage")
    return chunks.withColumn("chunk_type", kind).join(modal, [doc, "cluster"], "left").join(shared, [doc, "cluster"]).withColumn("token_estimate", tx.token_estimate_by_chars(F.col("raw_text"))).drop("halved")


# --- after the packers -----------------------------------------------------------------------

def post_process(chunks: DataFrame, doc: str, order: str, text: str = "text", least: int = 0, id: str = "chunk_id") -> DataFrame:
    """Drop chunks under ``least`` estimated tokens and repeats of a text in a document, number the others anew and link them."""
    kept = chunks.where(tx.token_estimate(F.col(text)) >= least) if least else chunks
    same = F.sha2(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), 256)
    first = kept.groupBy(doc, same.alias("__same")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in kept.columns]), order).alias("__row"))
    return numbered(first.select("__row.*"), doc, order, id)


def numbered(rows: DataFrame, doc: str, order: str, id: str) -> DataFrame:
    """Append chunk_index, total_chunks, prev_chunk_id and next_chunk_id of each document's rows in their order.

    A document may hold a third of all rows: rows are dealt to ranges of (document, order) and numbered there;
    what lies before a range, and the ids at its edges, come from one row for each document and range.
    """
    ranged = staged(rows.repartitionByRange(doc, order).withColumn("__part", F.spark_partition_id()))
    own, parts = Window.partitionBy("__part", doc).orderBy(order), Window.partitionBy(doc).orderBy("__part")
    edges = ranged.groupBy(doc, "__part").agg(F.count("*").alias("n"), F.min_by(id, order).alias("first"), F.max_by(id, order).alias("last"))
    edges = edges.select(
        doc, "__part", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy(doc)).alias("total_chunks"),
        F.lag("last").over(parts).alias("__prev"), F.lead("first").over(parts).alias("__next"))
    placed = ranged.withColumn("__at", F.row_number().over(own) - 1).withColumn("__p", F.lag(id).over(own)).withColumn("__n", F.lead(id).over(own))
    joined = placed.alias("r").join(edges.alias("e"), F.col("r.__part").eqNullSafe(F.col("e.__part")) & F.col(f"r.{doc}").eqNullSafe(F.col(f"e.{doc}")))
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r.__at") + F.col("e.__before")).alias("chunk_index"), "e.total_chunks", F.coalesce("r.__p", "e.__prev").alias("prev_chunk_id"), F.coalesce("r.__n", "e.__next").alias("next_chunk_id"))


def carried_headings(lines: DataFrame, doc: str, order: list[str], text: str = "text") -> DataFrame:
    """Body lines with the last heading before them (``section``), across pages; headings themselves are dropped."""
    heading = F.when(tx.looks_like_section(F.col(text)), F.col(text))
    found = stretches.carried(lines.withColumn("__h", heading), [doc], order, F.col("__h"), "section")
    return found.where("__h is null").drop("__h")


def document_chunks(elements: DataFrame, doc: str) -> DataFrame:
    """Per (doc, chunk): section title, texts, table and picture counts, element kinds in order and pages (-1 without any).

    Needs chunk, at, kind, text and page.
    """
    text_of = lambda keep, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "text")))), lambda s: s["text"]), sep)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int"))
    kinds = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda s: s["kind"]))
    out = elements.groupBy(doc, "chunk").agg(
        F.min_by(F.when(F.col("kind") == "Title", F.col("text")), F.when(F.col("kind") == "Title", F.col("at"))).alias("section_title"), text_of(F.col("kind") != "Table", "\n").alias("raw_text"),
        text_of(F.col("kind") == "Table", "\n\n").alias("tables_text"), count("Table").alias("table_count"), count("Image").alias("image_count"), count("ListItem").alias("list_item_count"),
        kinds.alias("element_types"), F.coalesce(F.min("page"), F.lit(-1)).alias("page_start"), F.coalesce(F.max("page"), F.lit(-1)).alias("page_end"))
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit("[SECTION: "), F.col("section_title"), F.lit("]")))
    table = F.when(F.col("tables_text") != "", F.concat(F.lit("[TABLE: "), F.col("tables_text"), F.lit("]")))
    return out.withColumn("embedding_text", F.concat_ws("\n\n", section, F.nullif(F.trim("raw_text"), F.lit("")), table)).withColumn("word_count", tx.n_words(F.col("raw_text"))).withColumn("text_preview", F.substring("raw_text", 1, 300))


# --- packers: one document at a time ---------------------------------------------------------

#: Rows that a packer's task turns into Python values at once, and that it sends on at once.
STREAMED = 1000
#: Characters of windows that text_windows() sends on at once.
WINDOW_CHARS = 2 << 20


def per_document(df: DataFrame, doc: str, order: str, columns: list[str], pack: Callable[[Iterator[tuple]], Iterator[dict]], out: str) -> DataFrame:
    """Rows that ``pack`` makes of each document's rows (tuples of ``columns``) in order, under the schema ``out`` after the document's key.

    Documents stream through their task in order, batch by batch, and what is packed goes on at once: of a document
    no more is held than ``pack`` holds, so it may have any number of rows.
    """
    fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([df.schema[doc], T.StructField("chunk_index", T.IntegerType()), *fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, STREAMED):
                    part = batch.slice(at, STREAMED)
                    yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)))

        made: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), kinds)], schema=kinds)

        for key, own in itertools.groupby(rows(), lambda r: r[0]):
            for i, r in enumerate(pack(x[1:] for x in own)):
                made.append((key, i, *(r[f.name] for f in fields)))
                if len(made) >= STREAMED:
                    yield batch_of()
                    made = []
        if made:
            yield batch_of()

    names = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(columns)]
    dealt = df.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{order}`").alias("__order"), *names).repartition("__doc").sortWithinPartitions("__doc", "__order")
    return dealt.drop("__order").mapInArrow(run, schema)


def released(out: list[dict]) -> Iterator[dict]:
    """All finished rows but the last, which what follows may still join."""
    while len(out) > 1:
        yield out.pop(0)


def sentence_tail(text: str, most: int) -> str:
    """The last sentence of the end of a text if it fits, else the end itself."""
    tail = text[-2 * most :]
    last = re.split(r"(?<=[.!?])\s+", tail)[-1]
    return last if 0 < len(last) <= most else text[-most:]


def split_long(text: str, most: int = HARD, overlap: int = OVERLAP) -> list[str]:
    """Cut after the last sentence in the first ``most`` characters if it is past their middle, else hard, then with overlap."""
    out = []
    while len(text) > most:
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text[:most])]
        if ends and ends[-1] > most // 2:
            out.append(text[: ends[-1]].strip())
            text = text[ends[-1] :].lstrip()
        else:
            out.append(text[:most].strip())
            text = text[max(1, most - overlap) :]
    return [*out, text.strip()] if text.strip() else out


def element_chunks(elements: DataFrame, doc: str, order: str = "at") -> DataFrame:
    """Pack elements (kind, content, page) to chunks of about SOFT characters, at most HARD, under title and heading anchors.

    Headings end a chunk and anchor what follows; tables and diagrams stand alone; a text that is too long is
    split; what overflows carries its last sentence on, unless a heading or a standalone element comes next.
    Chunks under TINY characters join the one before them with the same anchors.
    """

    def pack(rows: Iterator[tuple]) -> Iterator[dict]:
        out: list[dict] = []
        anchors = {"title": "", "heading": ""}
        held: list[tuple[str, int]] = []
        carry = ""

        def add(c: dict) -> None:
            before = out[-1] if out else None
            if before and len(c["text"]) < TINY and not c["standalone"] and not before["standalone"] and (c["title"], c["heading"]) == (before["title"], before["heading"]):
                before["text"] += "\n\n" + c["text"]
                before["page_end"] = max(before["page_end"], c["page_end"])
            else:
                out.append(c)

        def flush(alone: bool = False) -> None:
            nonlocal held
            text = "\n\n".join(t for t, _ in held).strip()
            if text and not (len(held) == 1 and text == carry):
                pages = [p for _, p in held]
                add({"text": text, **anchors, "page_start": min(pages), "page_end": max(pages), "standalone": alone})
            held = []

        for kind, content, page in rows:
            yield from released(out)
            content = (content or "").strip()
            if not content:
                continue
            if kind in HEADINGS or kind in STANDALONE:
                flush()
                carry = ""
                if kind in HEADINGS:
                    anchors["title" if kind == "Title" else "heading"] = content[:120]
                    if kind == "Title":
                        anchors["heading"] = ""
                else:
                    held = [(content, int(page))]
                    flush(alone=True)
                continue
            for part in split_long(content) if len(content) > HARD else [content]:
                size = sum(len(t) + 2 for t, _ in held)
                if held and (size + len(part) > HARD or size >= SOFT):
                    over = size + len(part) > HARD
                    text = "\n\n".join(t for t, _ in held)
                    flush()
                    carry = sentence_tail(text, OVERLAP) if over else ""
                    if carry and len(carry) + 2 + len(part) <= HARD:
                        held = [(carry, int(page))]
                held.append((part, int(page)))
        flush()
        yield from out

    return per_document(elements, doc, order, ["kind", "content", "page"], pack, "text string, title string, heading string, page_start int, page_end int, standalone boolean")


def packed_words(paragraphs: Iterable[str | None], most: int = 400, overlap: int = 60) -> Iterator[list[str]]:
    """Windows of words of at most ``most`` estimated tokens; a window begins with the last ``overlap`` words of the one before.

    A paragraph over the limit is packed by its sentences, one long sentence by fixed runs of words.  A last
    window under a third of the limit joins the one before if both fit with the overlap.
    """
    tokens = lambda n: max(1, int(n * 1.3))
    run = max(80, int(most / 1.3))

    def pieces(paragraph: str) -> list[list[str]]:
        words = paragraph.split()
        if tokens(len(words)) <= most:
            return [words] if words else []
        sentences = [s.split() for s in re.split(r"(?<=[.!?])\s+", paragraph)]
        out: list[list[str]] = []
        for s in sentences:
            out += [s] if tokens(len(s)) <= most else [s[i : i + run] for i in range(0, len(s), run)]
        return out

    windows: list[list[str]] = []
    now: list[str] = []
    fresh = 0
    for paragraph in paragraphs:
        for piece in pieces(paragraph or ""):
            if fresh and tokens(len(now) + len(piece)) > most:
                yield from windows  # the one before can't change any more
                windows = [now]
                now, fresh = (now[-overlap:] if overlap else []), 0
            now = now + piece
            fresh += len(piece)
    if fresh:
        if windows and fresh * 1.3 * 3 < most and tokens(len(windows[-1]) + fresh) <= most + overlap:
            windows[-1] = windows[-1] + now[-fresh:]
        else:
            windows.append(now)
    yield from windows


def word_windows(units: DataFrame, doc: str, order: str = "at", most: int = 400, overlap: int = 60, text: str = "text") -> DataFrame:
    """packed_words() of each document's paragraphs in their order, where they are rows of their own."""
    pack = lambda rows: ({"text": " ".join(w), "n_words": len(w)} for w in packed_words((t for (t,) in rows), most, overlap))
    return per_document(units, doc, order, [text], pack, "text string, n_words int")


def text_windows(docs: DataFrame, doc: str, text: str = "text", most: int = 400, overlap: int = 60) -> DataFrame:
    """packed_words() of the lines of whole texts, row by row: nothing is shuffled.  A worker makes a text after the other to Python values and sends windows on at WINDOW_CHARS."""
    base = docs.select(doc, F.col(text).alias("__text"))
    schema = T.StructType([base.schema[doc], *T.StructType.fromDDL("chunk_index int, text string, n_words int").fields])

    limit = WINDOW_CHARS

    def made_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, int]]:
        for i, whole in enumerate(batch.column(1)):
            for k, w in enumerate(packed_words((whole.as_py() or "").split("\n"), most, overlap)):
                yield i, k, " ".join(w), len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for one in itertools.chain(made_of(batch), [None]):
                if made and (one is None or held >= limit):
                    rows, index, texts, sizes = zip(*made)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=schema.names)
                    made, held = [], 0
                if one is not None:
                    made.append(one)
                    held += len(one[2])

    return base.mapInArrow(run, schema)


def caption_chunks(snippets: DataFrame, video: str, start: str = "start", most: int = 300, overlap: int = 40, least: int = 80, chapter: str | None = "chapter", text: str = "text") -> DataFrame:
    """Pack captions to chunks of about ``most`` words within chapters, each beginning with the last ``overlap`` words of the one before.

    At a chapter's end a rest of at least ``least`` words is a chunk; a shorter one joins the chunk before it, and is a chunk if there is none.
    """

    def pack(rows: Iterator[tuple]) -> Iterator[dict]:
        out: list[dict] = []
        held: list[str] = []
        begin = last = None
        fresh = 0
        current = None

        def close(rest: bool) -> None:
            nonlocal held, begin, fresh
            if fresh:
                if rest and fresh < least and out:
                    out[-1]["text"] += " " + " ".join(held[-fresh:])
                    out[-1]["end_sec"] = float(last)
                else:
                    out.append({"text": " ".join(held), "chapter": current, "start_sec": float(begin), "end_sec": float(last)})
            held, fresh = ([] if rest or not overlap else held[-overlap:]), 0
            begin = None

        for t, s, *named in rows:
            c = named[0] if named else ""
            yield from released(out)
            if current is not None and c != current:
                close(rest=True)
            current, last = c, s
            words = (t or "").split()
            begin = s if begin is None else begin
            held, fresh = held + words, fresh + len(words)
            if len(held) >= most:
                close(rest=False)
        if current is not None:
            close(rest=True)
        yield from out

    columns = [text, start, *([chapter] if chapter else [])]
    return per_document(snippets, video, start, columns, pack, "text string, chapter string, start_sec double, end_sec double")


def timed_captions(snippets: DataFrame, video: str, start: str = "start", most: int = 300, overlap: int = 40, least: int = 80, text: str = "text", lossless: bool = True) -> DataFrame:
    """Captions without chapters: chunks of about ``most`` words, cut at the last sentence end within 80 characters of the target.

    The next chunk begins right behind the cut.  Not ``lossless``: it begins with the last ``overlap`` words
    read, so words between the cut and these are in no chunk, and a video of fewer words than ``least`` has none.
    """

    def pack(rows: Iterator[tuple]) -> Iterator[dict]:
        out: list[dict] = []
        held: list[str] = []
        begin = last = None
        for t, s in rows:
            yield from released(out)
            begin, last = (s if begin is None else begin), s
            held = held + (t or "").split()
            if len(held) < most:
                continue
            whole = " ".join(held)
            near = int(len(whole) * most / len(held))
            low = max(0, near - 80)
            ends = [m.end() for m in re.finditer(r"[.!?]\s", whole[low : near + 80])]
            cut = whole[: low + ends[-1]].strip() if ends else whole
            out.append({"text": cut, "start_sec": float(begin), "end_sec": float(last)})
            held = held[len(cut.split()) :] if lossless else held[-overlap:]
            begin = None if not held else s
        if held and (len(held) >= least or not out and lossless):
            out.append({"text": " ".join(held), "start_sec": float(begin), "end_sec": float(last)})
        elif held and out:
            out[-1]["text"] += " " + " ".join(held)
        yield from out

    return per_document(snippets, video, start, [text, start], pack, "text string, start_sec double, end_sec double")


def paragraphs(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, at and text of each page's paragraphs: parted by blank lines, or, where there are none, lines merged up to an end mark or 90 words."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def merge(s: Column, line: Column) -> Column:
        now = F.when(s["now"] == "", line).otherwise(F.concat(s["now"], F.lit(" "), line))
        ends = line.rlike(r"[.!?;:]$") | (tx.n_words(now) >= 90)
        return F.struct(F.when(ends, F.array_append(s["done"], now)).otherwise(s["done"]).alias("done"), F.when(ends, "").otherwise(now).alias("now"))

    merged = F.aggregate(lines, start, merge, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    return pages.select(*keys, F.posexplode(F.when(F.size(parts) > 1, parts).otherwise(merged)).alias("at", "text"))


def markdown_elements(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, at, kind and content of a page's blank-line blocks, by how they begin."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = pages.select(*keys, F.posexplode(blocks).alias("at", "block"))
    b = F.col("block")
    headed = b.rlike(r"^#{1,3}\s")
    kind = F.when(headed & b.startswith("##"), "Heading").when(headed, "Title").when(b.rlike(r"^\$\$|^\\\["), "Equation").when(b.startswith("|"), "Table").when(b.rlike(r"(?i)^\[DIAGRAM:"), "Diagram").otherwise("Paragraph")
    return rows.select(*keys, "at", kind.alias("kind"), F.when(headed, F.trim(F.regexp_replace(b, r"^#+\s*", ""))).otherwise(b).alias("content"))


def audio_chunks(segments: DataFrame, keys: list[str], chunk: str, order: str, topics: str = "topics") -> DataFrame:
    """What describes a chunk of segments: text, words, times, confidences, doubt, and the topics that it names.

    Needs text, start, end, confidence, is_unclear and the lecture's topics.  Where no topic is named all are; the
    label is the topic named most often, the first of equals.
    """
    found = segments.groupBy(*keys, chunk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), " ").alias("text"), F.min("start").alias("start_seconds"), F.max("end").alias("end_seconds"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.min("confidence"), 4).alias("min_confidence"), F.coalesce(F.max("is_unclear"), F.lit(False)).alias("has_unclear_segments"),
        F.array_sort(F.collect_list(order)).alias("segment_indices"), F.first(topics, ignorenulls=True).alias("topics"))
    low, all_topics = F.lower("text"), F.coalesce("topics", F.array().cast("array<string>"))
    named = lambda t: (F.length(low) - F.length(F.replace(low, F.lower(t), F.lit("")))) / F.greatest(F.length(t), F.lit(1))
    active = F.filter(all_topics, lambda t: (t != "") & F.contains(low, F.lower(t)))
    best = F.array_max(F.transform(all_topics, lambda t, i: F.struct(named(t).alias("n"), (-i).alias("at"), t.alias("topic"))))
    return found.select(
        *keys, chunk, "text", tx.n_words(F.col("text")).alias("word_count"), "start_seconds", "end_seconds", F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(0.0)).alias("duration_seconds"),
        "avg_confidence", "min_confidence", "has_unclear_segments", "segment_indices", F.when(F.size(active) > 0, active).otherwise(all_topics).alias("concepts"), best["topic"].alias("concept_label"))


def window_metadata(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counts, density (distinct alphabetic words over words), mean positive confidence, warnings (20) and stages (30) of each window's units."""
    flat = lambda name, n: F.slice(F.array_distinct(F.flatten(F.collect_list(name))), 1, n)
    found = units.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda s: s[text]), "\n\n").alias("text"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 2).alias("confidence"), flat("warnings", 20).alias("warnings"), flat("stages", 30).alias("stages"), F.array_sort(F.collect_set("page")).alias("page_numbers"))
    words = tx.words(F.lower("text"))
    alphabetic = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")))
    return found.withColumns({"char_count": F.length("text"), "word_count": F.size(words), "line_count": F.size(F.split("text", "\n")), "token_count": tx.token_estimate(F.col("text")), "semantic_density": F.round(F.size(alphabetic) / F.greatest(F.size(words), F.lit(1)), 3)})


# --- sections of documents -------------------------------------------------------------------

# Most and soft characters of a chunk of a section, under which chunks are combined, and what a forced split repeats.
SECTION_MOST, SECTION_SOFT, SECTION_COMBINE, SECTION_OVERLAP = 3000, 2400, 500, 200


def sections(elements: Iterable[tuple[str, str | None, object]], most: int = SECTION_MOST, soft: int = SECTION_SOFT, combine: int = SECTION_COMBINE, overlap: int = SECTION_OVERLAP) -> Iterator[list[tuple]]:
    """Chunks of a document's elements (kind, text, page), as lists of (element, text, kind, page), as they are finished.

    A title begins a chunk, and so does an element after ``soft`` characters, or that would go over ``most``.  An
    element that is longer than ``most`` is split by itself, at a blank where there is one, each part after the
    first beginning with the last ``overlap`` characters of the one before.  Then a chunk under ``combine``
    characters takes in the next as long as both fit.  Elements in a chunk are two characters apart.
    """
    size = lambda chunk: sum(len(e[1]) for e in chunk) + 2 * max(len(chunk) - 1, 0)

    def cut() -> Iterator[tuple[list[tuple], bool]]:
        """Chunks, and whether each is a part of one element."""
        now: list[tuple] = []
        for i, (kind, text, page) in enumerate(elements):
            if not text:
                continue
            if now and (kind == "Title" or size(now) >= soft or size(now) + 2 + len(text) > most):
                yield now, False
                now = []
            if len(text) <= most:
                now.append((i, text, kind, page))
                continue
            while len(text) > most:
                at = text.rfind(" ", overlap + 1, most + 1)
                at = at if at > 0 else most
                yield [(i, text[:at], kind, page)], True
                text = text[at - overlap :] if overlap else text[at:].lstrip()
            yield [(i, text, kind, page)], True
        if now:
            yield now, False

    last: list[tuple] = []
    part_before = False
    for chunk, part in cut():
        if last and not part and not part_before and size(last) < combine and size(last) + 2 + size(chunk) <= most:
            last = last + chunk
        else:
            if last:
                yield last
            last = chunk
        part_before = part
    if last:
        yield last


def section_parts(kinds: list[str], texts: list[str], **sizes: int) -> list[list[tuple[int, str]]]:
    """sections() of elements without pages, as lists of (element, text)."""
    return [[(i, t) for i, t, _, _ in chunk] for chunk in sections(((k, t, None) for k, t in zip(kinds, texts)), **sizes)]


def title_chunks(elements: DataFrame, doc: str, order: str = "at", **sizes: int) -> DataFrame:
    """Rows of elements under the chunk that holds them: doc, chunk_index (of the rows), chunk, at, kind, text and page, as document_chunks() needs them."""

    def pack(rows: Iterator[tuple]) -> Iterator[dict]:
        for c, chunk in enumerate(sections(rows, **sizes)):
            for i, t, kind, page in chunk:
                yield {"chunk": c, "at": i, "kind": kind, "text": t, "page": page}

    return per_document(elements, doc, order, ["kind", "text", "page"], pack, "chunk int, at int, kind string, text string, page int")


def merged_windows(windows: DataFrame, doc: str, order: str, least: int, most: int, overlap: int = 60, text: str = "text") -> DataFrame:
    """doc, window, text and n_words: windows under twice ``least`` estimated tokens join the one before if both have at most most + overlap."""
    tokens = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(1.3)).cast("int"))
    rows = windows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(text, F.lit("")).alias("text"), tx.n_words(F.col(text)).alias("n")))).alias("rows"))
    start = F.array().cast("array<struct<text:string,n:int>>")

    def join(made: Column, row: Column) -> Column:
        before = F.element_at(made, -1)
        small = (F.size(made) > 0) & (tokens(row["n"]) < 2 * least) & (tokens(F.try_add(before["n"], row["n"])) <= most + overlap)
        merged = F.struct(F.concat(before["text"], F.lit("\n\n"), row["text"]).alias("text"), (before["n"] + row["n"]).alias("n"))
        return F.when(small, F.array_append(F.slice(made, 1, F.size(made) - 1), merged)).otherwise(F.array_append(made, F.struct(row["text"].alias("text"), row["n"].alias("n"))))

    folded = rows.select(doc, F.posexplode(F.aggregate("rows", start, lambda made, row: F.when(F.size(made) > 0, join(made, row)).otherwise(F.array(F.struct(row["text"].alias("text"), row["n"].alias("n")))))).alias("window", "w"))
    return folded.select(doc, "window", F.col("w.text").alias("text"), F.col("w.n").alias("n_words"))


def lecture_chunks(parts: dict[str, DataFrame]) -> DataFrame:
    """The chunks of several strategies as one table, with ``strategy``; a column that one of them lacks is null there."""
    union = None
    for strategy, df in parts.items():
        own = df.withColumn("strategy", F.lit(strategy))
        union = own if union is None else union.unionByName(own, allowMissingColumns=True)
    return union


def transcript_chunks(snippets: DataFrame, chapters: DataFrame, video: str, start: str = "start", chapter_start: str = "chapter_start", title: str = "title", **sizes: int) -> DataFrame:
    """Chunks of captions by chapter where a video has any, else by time: caption_chunks() and timed_captions() under the same columns."""
    have = chapters.select(video).distinct()
    within = as_of_chapter(snippets.join(have, video, "left_semi"), chapters, video, start, chapter_start, title)
    chaptered = caption_chunks(within, video, start, **sizes)
    plain = timed_captions(snippets.join(have, video, "left_anti"), video, start, **sizes).withColumn("chapter", F.lit(None).cast("string"))
    return chaptered.unionByName(plain)


def zipped(chunks: DataFrame, vectors: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors by id; an error if either has an id that the other lacks."""
    missing = F.raise_error(F.lit("chunks and vectors don't have the same ids"))
    joined = chunks.withColumn("__c", F.lit(1)).join(vectors.select(id, "embedding"), id, "full")
    return joined.withColumn("embedding", F.when(F.col("__c").isNull() | F.col("embedding").isNull(), missing.cast(vectors.schema["embedding"].dataType)).otherwise(F.col("embedding"))).drop("__c")


def preview(chunks: DataFrame, most: int = 20, chars: int = 300, id: str = "chunk_id", text: str = "text") -> DataFrame:
    """The first ``most`` chunks by id with the head of their text: nothing is embedded or stored."""
    return chunks.select(id, F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("preview"), tx.n_words(F.col(text)).alias("n_words")).orderBy(id).limit(most)
