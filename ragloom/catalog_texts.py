"""Further registered queries: text scalars, ids, display texts, prompts and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.catalog import TOKENS, WORDS, query, table
from ragloom.functions import display
from ragloom.functions import text as tx
from ragloom.operators import chunking, keywords, ocr, relational
from ragloom.sources import readers, writers


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


SPACE = r"[ \t\n\x0B\f\r]"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{3,}}'), lambda t: t NOT IN ({listed(tx.ANSWER_STOPWORDS)})))), ' ') AS answer_tokens,
array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9]{{3,}}'))), ' ') AS plain_tokens, array_to_string({TOKENS.format("text")}, ' ') AS tokens FROM documents""")
def t2_t3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.answer_tokens(text)), " ").alias("answer_tokens"), F.array_join(F.array_sort(tx.plain_tokens(text)), " ").alias("plain_tokens"), F.array_join(tx.tokens(text), " ").alias("tokens"))


@query(f"""WITH terms AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\b[a-z][a-z_-]{{3,}}\\b'), lambda t: t NOT IN ({listed(tx.CAPTION_STOPWORDS)})) AS toks FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g') AS text FROM documents))),
counted AS (SELECT doc_id, term, count(*) AS n, min(place) AS first FROM terms GROUP BY doc_id, term), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted)
SELECT d.doc_id, coalesce(string_agg(term, ', ' ORDER BY rank), '') AS tags FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND rank <= 8 GROUP BY d.doc_id""")
def t5_caption_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other than ASCII letters count as blanks here, as the two engines' word boundaries differ."""
    plain = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]+", " "))
    return keywords.caption_tags(plain, "doc_id")


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([a-zA-Z0-9_])-\n([a-zA-Z0-9_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS n FROM documents)
SELECT doc_id, sha256(cleaned) AS cleaned, sha256(regexp_replace(n, '^\s+|\s+$', '', 'g')) AS normalised FROM c""")
def t10_t11_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.cleaned(text), 256).alias("cleaned"), F.sha2(tx.normalised(text), 256).alias("normalised"))


@query(r"""WITH p AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '’', ''''), '“', '"'), '”', '"'), '—', '-'), '–', '-'), '×', '*'), '÷', '/'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '•', '-') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b([A-Z])\s([a-z])', '\1\2', 'g'), '\s{2,}', ' ', 'g'), '([a-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS prose FROM p""")
def t12_ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(ocr.clean_text(F.col("text")), 256).alias("prose"))


@query("""SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(a, b) = coalesce(b, a) THEN CAST(coalesce(a, b) AS VARCHAR) ELSE a || '–' || b END AS label
FROM (SELECT event_id, nullif(event_id % 5, 0) AS a, nullif(event_id % 5 + event_id % 3, 1) AS b FROM events)""")
def t15_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.nullif(F.col("event_id") % 5, F.lit(0)), F.nullif(F.col("event_id") % 5 + F.col("event_id") % 3, F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", tx.page_label(first, last).alias("label"))


@query("""SELECT doc_id, substr(md5(source || ':' || (doc_id % 7) || ':' || substr(text, 1, 100)), 1, 12) AS qna, substr(sha256(lang || '|concept|' || (doc_id % 9)), 1, 24) AS audio, substr(sha256(source || '::' || doc_id), 1, 32) AS document,
substr(sha256(doc_id || ':' || substr(text, 1, 200)), 1, 16) AS image, substr(sha256(source || '::hw::' || doc_id), 1, 32) AS handwritten, substr(sha256(source || '::yt::' || doc_id), 1, 32) AS video FROM documents""")
def t18_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, text, source = F.col("doc_id"), F.col("text"), F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.qna_id(source, doc % 7, text).alias("qna"), tx.lecture_chunk_id(F.col("lang"), F.lit("concept"), doc % 9).alias("audio"), tx.chunk_id(source, doc).alias("document"),
        tx.image_chunk_id(doc, text).alias("image"), tx.handwritten_chunk_id(source, doc).alias("handwritten"), tx.video_chunk_id(source, doc).alias("video"))


HINTED = "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'A difficult one. ' WHEN 1 THEN 'Easy, then hard: ' WHEN 2 THEN 'BASIC ' ELSE '' END || text || CASE item_id % 3 WHEN 0 THEN ' [' || (item_id % 12) || ' marks]' WHEN 1 THEN ' [3 PTS] [4 points]' ELSE '' END AS t FROM benchmark"


@query(rf"""WITH h AS ({HINTED}), w AS (SELECT *, regexp_extract(lower(t), '\b(advanced|basic|difficult|easy|hard|medium|simple)\b', 1) AS level, regexp_extract(lower(t), '\[(\d{{1,9}})\s*(?:marks?|pts?|points?)\]', 1) AS m FROM h)
SELECT item_id, CASE WHEN level IN ('easy', 'simple', 'basic') THEN 'easy' WHEN level = 'medium' THEN 'medium' WHEN level <> '' THEN 'hard' END AS difficulty, CAST(nullif(m, '') AS BIGINT) AS marks FROM w""")
def t19_levels_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    before = F.when(item % 5 == 0, "A difficult one. ").when(item % 5 == 1, "Easy, then hard: ").when(item % 5 == 2, "BASIC ").otherwise("")
    after = F.when(item % 3 == 0, F.concat(F.lit(" ["), (item % 12).cast("string"), F.lit(" marks]"))).when(item % 3 == 1, " [3 PTS] [4 points]").otherwise("")
    text = F.concat(before, F.col("text"), after)
    return table(spark, sf_dir, "benchmark").select("item_id", tx.difficulty(text).alias("difficulty"), tx.marks(text).alias("marks"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL"
SECTION = rf"""length(trim(line)) BETWEEN 1 AND 110 AND NOT regexp_matches(trim(line), '[.,;]$') AND (regexp_matches(lower(trim(line)), '^(chapter|unit|section|module|lecture|part|topic|appendix)\b|^\d+(\.\d+)*[.)]?\s+\S')
OR (len({WORDS.format("trim(line)")}) <= 10 AND regexp_matches(line, '[A-Za-z]') AND (upper(trim(line)) = trim(line) OR len(list_filter({WORDS.format("trim(line)")}, lambda x: regexp_matches(x, '^[^A-Z]*[a-z]'))) = 0)))"""


@query(f"WITH l AS ({LINES}) SELECT doc_id, place, {SECTION} AS heading FROM l")
def t21_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", F.col("at").alias("place"), tx.looks_like_section(F.col("line")).alias("heading"))


@query(f"""WITH l AS ({LINES}), h AS (SELECT *, CASE WHEN {SECTION} THEN line END AS h FROM l)
SELECT doc_id, place, section FROM (SELECT doc_id, place, h, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h) WHERE h IS NULL""")
def c13_carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return chunking.carried_headings(lines, "doc_id", ["at"]).select("doc_id", F.col("at").alias("place"), "section")


@query(r"""WITH b AS (SELECT doc_id, doc_id % 1000 AS top, trim(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'unknown' WHEN top < 150 AND length(t) < 120 AND NOT contains(t, chr(10)) THEN 'heading' WHEN regexp_matches(t, '^\s*[-•*]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s') THEN 'list_item'
WHEN top > 850 AND length(t) < 200 THEN 'caption' WHEN len(regexp_extract_all(t, '[∑∫∂∇×÷±√∞αβγδεζηθ=<>]')) >= 2 THEN 'formula' ELSE 'paragraph' END AS kind FROM b""")
def t23_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ocr.block_type(F.col("text"), F.col("doc_id") % 1000, F.lit(1000)).alias("kind"))


@query(f"""WITH w AS (SELECT doc_id, source, lang, {WORDS.format("text")} AS w FROM documents)
SELECT doc_id, substr(trim(CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN coalesce(nullif(lang, ''), 'YouTube Lecture') ELSE source END), 1, 80) AS topic, array_to_string(w[1:70], ' ') || CASE WHEN len(w) > 70 THEN '...' ELSE '' END AS summary FROM w""")
def t24_caption_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    found = display.caption_metadata(F.col("text"), F.when(doc % 4 == 1, F.col("lang")).otherwise("unused"), F.when(doc % 4 == 1, F.lit("Unknown")).otherwise(F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", found["topic"].alias("topic"), found["summary"].alias("summary"))


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS object FROM events""")
def t25_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says around an object: a fence, words, or no object at all."""
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here: "), "props", F.lit(" Done."))).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise("none at all")
    return table(spark, sf_dir, "events").select("event_id", tx.json_object(said).alias("object"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'qna' WHEN doc_id % 5 = 0 THEN 'youtube' WHEN doc_id % 3 = 0 THEN 'handwritten' ELSE NULL END AS key FROM documents""")
def t26_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 6 == 0, "x").alias("topic_cluster"), F.when(doc % 5 == 0, "x").alias("video_id"), F.when(doc % 3 == 0, "x").alias("ink_quality"))
    return docs.select("doc_id", readers.source_key(docs.columns).alias("key"))


@query("""SELECT doc_id, '[' || concat_ws(' | ', 'C' || (doc_id % 7), nullif(source, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ''), CASE WHEN doc_id % 3 = 0 THEN 'Page ' || (doc_id % 9) ELSE 'Pages ' || (doc_id % 9) || '-' || (doc_id % 9 + doc_id % 3) END) || ']' AS header FROM documents""")
def t30_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    header = display.context_header(F.concat(F.lit("C"), (doc % 7).cast("string")), F.col("source"), F.when(doc % 2 == 0, F.col("lang")).otherwise(""), F.lit(None).cast("string"), doc % 9, doc % 9 + doc % 3)
    return table(spark, sf_dir, "documents").select("doc_id", header.alias("header"))


@query("""SELECT doc_id, '[IMAGE TYPE: ' || coalesce(lang, '') || ']' || chr(10) || '[IMAGE SUMMARY: ' || coalesce(text, '') || ']' || chr(10) || '[IMAGE EDUCATIONAL VALUE: high]' ||
CASE WHEN doc_id % 2 = 0 THEN chr(10) || '[IMAGE DETECTED TEXT: seen]' ELSE '' END || chr(10) || '[IMAGE KEY ENTITIES: ' || source || ', b]' || chr(10) || '[IMAGE KEYWORDS: k]' AS shown FROM documents""")
def t31_image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.struct(
        F.col("lang").alias("image_type"), F.col("text").alias("summary"), F.lit("high").alias("educational_value"), F.when(F.col("doc_id") % 2 == 0, "seen").otherwise("").alias("detected_text"),
        F.array("source", F.lit("b")).alias("key_entities"), F.array().cast("array<string>").alias("relationships"), F.array(F.lit("k")).alias("searchable_keywords"))
    return table(spark, sf_dir, "documents").select("doc_id", display.image_text(summary).alias("shown"))


@query("""SELECT item_id, 'You are a course assistant. Mode: ask.' || chr(10) || 'Answer from the numbered context alone and cite it as [n].' || chr(10) || 'Expected format: ' || CASE WHEN item_id % 2 = 0 THEN 'list' ELSE 'any' END || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: why' AS prompt FROM benchmark""")
def r19_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = display.answer_prompt(F.lit("why"), F.lit("ask"), F.when(F.col("item_id") % 2 == 0, "list"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", prompt.alias("prompt"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS citation_no, source, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS document, CAST(doc_id % 9 AS VARCHAR) AS page_range, substr(coalesce(text, ''), 1, 320) AS preview FROM documents""")
def r21_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    shown = ranked.select("doc_id", F.col("source").alias("key"), "rank", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("source_file"), F.col("source").alias("file_name"), (F.col("doc_id") % 9).cast("string").alias("page_range"), "text")
    return display.sources(shown, ["doc_id", "key"]).withColumnRenamed("key", "source")


# --- sources and sinks -----------------------------------------------------------------------

UPLOADS = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'https://youtu.be/abcdefghij' || (event_id % 10) END AS url, 'f' || event_id || ['.pdf', '.MP3', '.exe', '.docx', '', '.png'][event_id % 6 + 1] AS path FROM events"


@query(f"""WITH u AS ({UPLOADS}), e AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM u), p AS (SELECT *, CASE WHEN url IS NOT NULL THEN 'youtube' WHEN ext IN ('pdf', 'pptx', 'docx', 'txt', 'md') THEN 'documents' WHEN ext IN ('mp3', 'wav', 'm4a', 'aac', 'ogg', 'flac', 'mp4', 'webm') THEN 'audio' END AS pipeline FROM e)
SELECT event_id, pipeline, CASE WHEN pipeline IS NULL THEN 'unsupported file type: ' || ext END AS reason FROM p""")
def s13_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    kinds = F.array(*map(F.lit, (".pdf", ".MP3", ".exe", ".docx", "", ".png")))
    uploads = table(spark, sf_dir, "events").select("event_id", F.when(event % 7 == 0, F.concat(F.lit("https://youtu.be/abcdefghij"), (event % 10).cast("string"))).alias("url"), F.concat(F.lit("f"), event.cast("string"), F.get(kinds, event % 6)).alias("path"))
    accepted, rejects = readers.route(uploads)
    return accepted.select("event_id", "pipeline", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("event_id", F.lit(None).cast("string").alias("pipeline"), "reason"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'abcdefghi_' || (event_id % 10) WHEN 1 THEN 'ABCDEFGHIJ' || (event_id % 10) WHEN 2 THEN 'abcde-ghij' || (event_id % 10) END AS video FROM events""")
def s11_video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    digit = (event % 10).cast("string")
    url = F.when(event % 4 == 0, F.concat(F.lit("https://youtu.be/abcdefghi_"), digit)).when(event % 4 == 1, F.concat(F.lit("https://x.y/watch?v=ABCDEFGHIJ"), digit, F.lit("&t=1"))).when(event % 4 == 2, F.concat(F.lit("abcde-ghij"), digit)).otherwise("https://x.y/none")
    return table(spark, sf_dir, "events").select("event_id", tx.video_id(url).alias("video"))


@query("""WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE trim(text) <> '')
SELECT conv_id, place // 3 + 1 AS page, string_agg(text, chr(10) ORDER BY place) AS text FROM p GROUP BY conv_id, place // 3 + 1""")
def s2_paragraph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.paragraph_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", size=3)


@query("""WITH t AS (SELECT event_id, user_id, ['en', 'de', 'fr'][event_id % 3 + 1] AS language, event_id % 4 = 0 AS is_generated FROM events)
SELECT user_id, language, is_generated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_generated, CASE language WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, language) AS r FROM t) WHERE r = 1""")
def s9_preferred_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    tracks = table(spark, sf_dir, "events").select("user_id", F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), event % 3).alias("language"), (event % 4 == 0).alias("is_generated"))
    return readers.preferred_captions(tracks, ["de", "en"], "user_id")


@query(r"""SELECT page_id, regexp_matches(url, '\.html$') AND page_id % 3 <> 0 AS valid FROM pages""")
def s12_valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files and rejects together; every third is renamed to what is not allowed."""
    pages = table(spark, sf_dir, "pages").withColumn("path", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".bin"))).otherwise(F.col("url")))
    good, bad = readers.valid_files(pages, ("html",))
    return good.select("page_id", F.lit(True).alias("valid")).unionByName(bad.select("page_id", F.lit(False).alias("valid")))


@query("""SELECT doc_id, substr(text, 1, 8000) AS raw_text, substr(text, 1, 300) AS text_preview, CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 ELSE -1 END AS year_hint, array_to_string(list_transform(range(0, least(doc_id % 60, 50)), lambda i: 'k' || i), ',') AS keywords, array_to_string(list_transform(range(0, doc_id % 3), lambda i: CAST(i AS VARCHAR)), ',') AS pages FROM documents""")
def k4_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    made = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("raw_text"), F.col("text").alias("text_preview"), F.when(doc % 2 == 0, doc % 30).alias("year_hint"), F.transform(upto(doc % 60), lambda i: F.concat(F.lit("k"), i.cast("string"))).alias("keywords"), upto(doc % 3).alias("pages"))
    return writers.shaped(made).withColumn("keywords", F.array_join("keywords", ",")).withColumn("pages", F.array_join("pages", ","))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, n_chars FROM documents""")
def k8_store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = writers.store_records(table(spark, sf_dir, "documents"), "doc_id")
    return records.select(F.col("id").cast("string").alias("id"), "text", F.col("metadata.lang").alias("lang"), F.col("metadata.source").alias("source"), F.col("metadata.n_chars").alias("n_chars"))


@query("""SELECT source, count(*) AS n FROM (SELECT 'documents' AS source, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS id FROM documents UNION ALL SELECT 'qna', item_id FROM benchmark) WHERE id IS NOT NULL GROUP BY source""")
def k7_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("chunk_id"), "text", "lang")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return writers.seed({"documents": docs, "qna": items})[1]


@query("""SELECT event_id, CASE WHEN contains(lower(event_type), 'view') OR event_id % 3 = 0 THEN 'video' ELSE 'document' END AS kind FROM events""")
def j11_material_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = relational.material_kind(F.when(F.col("event_type") == "view", "VIDEO/mp4").otherwise(F.col("event_type")), F.when(F.col("event_id") % 3 == 0, "my YouTube talk").otherwise("notes"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
