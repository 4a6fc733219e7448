"""Sources: routing of uploads, text pages, HTML elements, captions, and validation with rejects."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions import text as tx
from ragloom.sources import elements

# The extensions of each pipeline.
DOCUMENTS, AUDIO = ("pdf", "pptx", "docx", "txt", "md"), ("mp3", "wav", "m4a", "aac", "ogg", "flac", "mp4", "webm")
IMAGES, QUESTIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf"), ("pdf", "docx", "pptx")
PARAGRAPHS_A_PAGE = 50


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(uploads: DataFrame, path: str = "path", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(accepted with ``pipeline``, rejects with ``reason``): links of videos, documents and audio are taken."""
    ext = extension(F.col(path))
    pipeline = F.when(tx.video_id(F.col(url)).isNotNull(), "youtube").when(ext.isin(*DOCUMENTS), "documents").when(ext.isin(*AUDIO), "audio")
    routed = uploads.withColumn("pipeline", pipeline)
    return routed.where("pipeline is not null"), routed.where("pipeline is null").drop("pipeline").withColumn("reason", F.concat(F.lit("unsupported file type: "), F.coalesce(ext, F.lit(""))))


def valid_files(paths: DataFrame, allowed: tuple[str, ...], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with an allowed extension, and the others."""
    ok = F.coalesce(extension(F.col(path)).isin(*allowed), F.lit(False))
    return paths.where(ok), paths.where(~ok)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, whole."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def paragraph_pages(paragraphs: DataFrame, doc: str, order: str, text: str = "text", size: int = PARAGRAPHS_A_PAGE) -> DataFrame:
    """doc, page and text: non-blank paragraphs, ``size`` to a page."""
    kept = paragraphs.where(F.trim(text) != "")
    at = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    paged = kept.withColumn("at", at).withColumn("page", (F.floor(F.col("at") / size) + 1).cast("int"))
    return paged.groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda s: s[text]), "\n").alias("text"))


def html_elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, at, kind and text of the titles, paragraphs, list items, table cells and code of pages, in page order.  JVM functions only."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|head|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    marked = F.regexp_replace(bare, r"(?i)<(h[1-6]|p|li|td|th|pre|blockquote)\b[^>]*>", "\x01$1\x02")
    closed = F.regexp_replace(marked, r"(?i)</(h[1-6]|p|li|td|th|pre|blockquote|div|ul|ol|table|article|section)\s*>", "\x01\x02")
    plain = F.regexp_replace(closed, r"<[^>]*>", " ")
    parts = pages.select(F.col(id), F.posexplode(F.split(plain, "\x01")).alias("part", "raw"))
    tag = F.lower(F.regexp_extract("raw", "^([A-Za-z0-9]*)\x02", 1))
    body = F.regexp_replace(F.regexp_replace("raw", "^[A-Za-z0-9]*\x02", ""), r"\s+", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    kinds = F.when(tag.startswith("h"), "Title").when(tag == "li", "ListItem").when(tag.isin("td", "th"), "Table").when(tag == "pre", "Code").otherwise("NarrativeText")
    kept = parts.select(id, "part", kinds.alias("kind"), F.trim(body).alias("text")).where("text <> ''")
    return kept.select(id, (F.row_number().over(Window.partitionBy(id).orderBy("part")) - 1).alias("at"), "kind", "text")


def tree_elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, at, kind, text, level and rows of pages' elements by their tree: depths of titles and items, tables with their cells, nested ones too."""
    own = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{html}`").alias("html"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = elements.html_elements(batch.column(1)[i].as_py() or "")
                ids = batch.column(0).slice(i, 1).take(pa.array([0] * len(found), pa.int64()))
                columns = [pa.array([e.kind for e in found], pa.string()), pa.array([e.text for e in found], pa.string()), pa.array([e.level for e in found], pa.int32()), pa.array([e.rows for e in found], pa.list_(pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(found)), pa.int64()), *columns], names=["id", "at", "kind", "text", "level", "rows"])

    return own.mapInArrow(run, f"id {kind}, at long, kind string, text string, level int, rows array<array<string>>").withColumnRenamed("id", id)


def preferred_captions(tracks: DataFrame, languages: list[str], video: str = "video_id") -> DataFrame:
    """One caption track of each video: written ones before generated ones, then by the order of languages."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]), F.col("language")), F.lit(len(languages)))
    at = F.row_number().over(Window.partitionBy(video).orderBy("is_generated", rank, "language"))
    return tracks.withColumn("__at", at).where("__at = 1").drop("__at")


def source_key(columns: list[str]) -> Column:
    """The source that a chunk's filled fields betray; null if none does."""
    marks = [("qna", "topic_cluster"), ("youtube", "video_id"), ("audio", "lecture_id"), ("image", "image_type"), ("handwritten", "ink_quality"), ("documents", "element_types")]
    out = F.lit(None).cast("string")
    for source, name in reversed(marks):
        if name in columns:
            out = F.when(F.col(name).isNotNull(), source).otherwise(out)
    return out


# --- office files ----------------------------------------------------------------------------

def docx_paragraphs(data: bytes) -> list[str]:
    """Texts of a DOCX file's paragraphs, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in body.iter() if p.tag.endswith("}p")]


def pptx_slides(data: bytes) -> list[str]:
    """Text of each slide of a PPTX file: its paragraphs on lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        slides = [ElementTree.fromstring(z.read(n)) for n in names]
    return ["\n".join(filter(None, ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")).strip() for p in s.iter() if p.tag.endswith("}p")))) for s in slides]


def docx_pages(data: bytes) -> list[str]:
    """Non-blank paragraphs, PARAGRAPHS_A_PAGE to a page."""
    kept = [p for p in docx_paragraphs(data) if p.strip()]
    return ["\n".join(kept[i : i + PARAGRAPHS_A_PAGE]) for i in range(0, len(kept), PARAGRAPHS_A_PAGE)]


EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {
    "docx": docx_pages, "pptx": pptx_slides, "txt": lambda data: [data.decode("utf-8", "replace")], "md": lambda data: [data.decode("utf-8", "replace")],
}


def file_pages(files: DataFrame, extractors: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """path, page, text and error of files (path, content: spark.read.format("binaryFile")), read by their extension.

    ``extractors`` adds kinds, such as a PDF library's, or replaces them: bytes to the texts of pages.  A file that
    can't be read gives one row with its error and no page; other files go on.
    """
    known = {**EXTRACTORS, **(extractors or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = (path or "").rpartition(".")[2].lower()
                try:
                    if kind not in known:
                        raise ValueError(f"unsupported file type: {kind}")
                    rows += [(path, i + 1, text, None) for i, text in enumerate(known[kind](content or b""))]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def fixtures(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literal rows; a field that a row lacks is null."""
    names = T.StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
