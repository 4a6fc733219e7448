"""How chunks are shown: citations, display and search texts, headers, prompts.  Column expressions over the wide chunk schema.

A field that the schema lacks counts as null; an empty text counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as tx

#: The fields that the expressions read, with their types; wide() adds those that are missing.
FIELDS = {
    "source": "string", "text": "string", "raw_text": "string", "transcript": "string", "text_preview": "string", "source_file": "string", "file_name": "string", "title": "string",
    "page_range": "string", "year_hint": "int", "marks_hint": "int", "questions": "array<string>", "answers": "array<string>", "image_type": "string", "image_summary": "string",
    "gemini_summary": "string", "gemini_topic": "string", "gemini_keywords": "array<string>", "lecture_title": "string", "professor": "string", "week_number": "int", "start_label": "string",
    "end_label": "string", "video_title": "string", "chapter_title": "string", "deep_link": "string", "section_title": "string", "section": "string", "keywords": "string", "topic": "string",
    "topic_label": "string", "summary": "string", "has_equations": "boolean", "chunk_type": "string", "strategy": "string", "content_type": "string",
}


def wide(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({c: F.lit(None).cast(kind) for c, kind in FIELDS.items() if c not in chunks.columns})


def some(*names: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n) if isinstance(n, str) else n, F.lit("")) for n in names])


def by_source(cases: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in cases.items():
        out = F.when(F.col("source") == name, value).otherwise(out)
    return out


def citation() -> Column:
    """What a chunk is cited as, its parts joined by a middle dot."""
    label = lambda name, *parts: F.concat_ws(" · ", F.coalesce(name, F.lit("")), *parts)
    pages = F.concat(F.lit("pp. "), some("page_range"))
    span = F.concat(F.lit("@ "), some("start_label"), F.lit("–"), F.coalesce("end_label", F.lit("")))
    marks = F.when(F.col("marks_hint") > 0, F.concat(F.lit("["), F.col("marks_hint").cast("string"), F.lit(" marks]")))
    year = F.when(F.col("year_hint") > 0, F.col("year_hint").cast("string"))
    return by_source({
        "qna": label(some("source_file", F.lit("Q&A Sheet")), pages, year, marks),
        "image": label(some("source_file", F.lit("Scanned Material")), pages, F.initcap(F.replace(some("image_type"), F.lit("_"), F.lit(" ")))),
        "audio": label(some("lecture_title", "source_file", F.lit("Lecture")), span, some("professor"), F.when(F.col("week_number") != 0, F.concat(F.lit("Week "), F.col("week_number").cast("string")))),
        "youtube": label(some("video_title", F.lit("YouTube Lecture")), F.concat(F.lit("@ "), some("start_label")), F.when(F.col("chapter_title") != "Unknown", some("chapter_title"))),
        "documents": label(some("source_file", F.lit("Course Document")), pages, F.concat(F.lit("§ "), some("section_title"))),
        "handwritten": label(some("source_file", F.lit("Handwritten Notes")), F.concat(F.lit("p. "), some("page_range")), some("topic")),
    }, some("source_file", "source"))


def display_text() -> Column:
    """What a reader sees of a chunk."""
    text = F.coalesce("text", F.lit(""))
    numbered = lambda name, mark: F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x, i: F.concat(F.lit(mark), (i + 1).cast("string"), F.lit(": "), x))
    pairs = F.concat(numbered("questions", "Q"), numbered("answers", "A"))
    return by_source({
        "qna": F.when(F.size(pairs) > 0, F.array_join(pairs, "\n")).otherwise(text),
        "audio": F.when(some("start_label").isNotNull(), F.concat(F.lit("[Lecture @ "), F.col("start_label"), F.lit("–"), F.coalesce("end_label", F.lit("")), F.lit("]\n"), text)).otherwise(text),
        "youtube": F.when(some("deep_link").isNotNull(), F.concat(F.lit("[YouTube @ "), F.coalesce("start_label", F.lit("")), F.lit(" — "), F.col("deep_link"), F.lit("]\n"), text)).otherwise(text),
        "image": F.when(some("image_summary").isNotNull(), F.concat(F.lit("[Image: "), F.coalesce("image_type", F.lit("")), F.lit("]\nSummary: "), F.col("image_summary"), F.lit("\n\nExtracted text:\n"), text)).otherwise(text),
        "handwritten": F.concat(F.when(F.col("has_equations"), "[has equations] ").otherwise(""), text),
    }, text)


def search_text() -> Column:
    """The text of a chunk that keyword search reads."""
    words = lambda *parts: F.concat_ws(" ", *parts)
    asked = F.array_join(F.concat(F.coalesce("questions", F.array().cast("array<string>")), F.coalesce("answers", F.array().cast("array<string>"))), " ")
    spoken = some("raw_text", "text", "transcript", "text_preview")
    return F.coalesce(by_source({
        "qna": some(asked, "raw_text"),
        "image": words(some("raw_text"), some("gemini_summary"), some("gemini_topic"), F.nullif(F.array_join("gemini_keywords", " "), F.lit(""))),
        "handwritten": words(F.nullif(F.coalesce("transcript", "raw_text"), F.lit("")), some("topic"), some("summary")),
        "documents": words(F.nullif(F.coalesce("raw_text", "text_preview"), F.lit("")), some("section_title"), some("keywords")),
    }, spoken), F.lit(""))


def retrieved(chunks: DataFrame) -> DataFrame:
    """The common view of chunks of any source: text, keywords (at most ten), file, section, topic, type, citation and display text."""
    own = wide(chunks)
    keywords = F.slice(F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != ""), 1, 10)
    common = own.withColumns({
        "text": F.coalesce(some("raw_text", "text", "transcript", "text_preview"), F.lit("")), "keyword_list": keywords, "source_file": some("source_file", "file_name"),
        "section_title": some("section_title", "section"), "topic": some("topic", "topic_label", "gemini_topic"), "chunk_type": some("chunk_type", "strategy", "content_type"),
    })
    return common.withColumn("citation", citation()).withColumn("display_text", display_text())


def context_header(course_id: Column, course_name: Column, title: Column, heading: Column, first: Column, last: Column) -> Column:
    page = F.when(first == last, F.concat(F.lit("Page "), first.cast("string"))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (course_id, course_name, title, heading)], page), F.lit("]"))


def image_text(summary: Column) -> Column:
    """The embedding text of a picture's summary struct: image_type, summary, educational_value, detected_text, key_entities, relationships, searchable_keywords."""
    line = lambda name, value: F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit(f"[IMAGE {name}: "), value, F.lit("]")))
    always = lambda name, value: F.concat(F.lit(f"[IMAGE {name}: "), F.coalesce(value, F.lit("")), F.lit("]"))
    return F.concat_ws(
        "\n", always("TYPE", summary["image_type"]), always("SUMMARY", summary["summary"]), always("EDUCATIONAL VALUE", summary["educational_value"]), line("DETECTED TEXT", summary["detected_text"]),
        line("KEY ENTITIES", F.array_join(summary["key_entities"], ", ")), line("RELATIONSHIPS", F.array_join(summary["relationships"], " | ")), line("KEYWORDS", F.array_join(summary["searchable_keywords"], ", ")))


def sources(selected: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cited chunk: number, document, page and a preview of 320 characters."""
    own = wide(selected)
    return own.select(*keys, F.col("rank").alias("citation_no"), some("source_file", "file_name", "title", F.lit("Course material")).alias("document"), "page_range", F.substring(F.coalesce("text", F.lit("")), 1, 320).alias("preview"))


def caption_metadata(text: Column, video_title: Column, chapter: Column) -> dict[str, Column]:
    """topic (chapter, or the video's title; 80 characters at most) and summary (the first 70 words)."""
    named = F.when((chapter != "") & (chapter != "Unknown"), chapter)
    topic = F.substring(F.trim(F.coalesce(named, F.nullif(video_title, F.lit("")), F.lit("YouTube Lecture"))), 1, 80)
    words = tx.words(text)
    head = F.array_join(F.slice(words, 1, 70), " ")
    return {"topic": topic, "summary": F.when(F.size(words) > 70, F.concat(head, F.lit("..."))).otherwise(head)}


def answer_prompt(question: Column, mode: Column, answer_format: Column, context: Column) -> Column:
    return F.concat(
        F.lit("You are a course assistant. Mode: "), mode, F.lit(".\nAnswer from the numbered context alone and cite it as [n].\nExpected format: "), F.coalesce(answer_format, F.lit("any")),
        F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)
