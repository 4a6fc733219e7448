"""Further registered queries: chunk tables, cache, courses, evaluation, budgets and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.catalog import PLANNED, SCHOOL, SCORED, SOURCE_NAMES, TOKENS, WORDS, asked_plans, query, school, spending, table, vectors_of
from ragloom.functions import text as tx
from ragloom.operators import cache, chunking, live, metrics, ocr, ranking, relational, vector_index, vectors
from ragloom.plans import planner
from ragloom.sources import files, readers, writers
from ragloom.sources.bucket_table import BucketTable
from ragloom.streaming import rate_limit


def pick(values: tuple, n) -> object:
    return F.get(F.array(*map(F.lit, values)), n)


# --- chunks ----------------------------------------------------------------------------------

@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END), ''), CASE WHEN doc_id % 2 = 0 THEN 'Topics covered:' || chr(10) || '- ' || source || chr(10) || '- b' END,
CASE WHEN doc_id % 3 = 0 THEN 'Key terms: x, ' || source END) AS text FROM documents""")
def c7_lecture_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, none = F.col("doc_id"), F.array().cast("array<string>")
    lectures = table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 5 == 0, " ").otherwise(F.col("text")).alias("summary"), F.when(doc % 2 == 0, F.array("source", F.lit("b"))).otherwise(none).alias("topics"), F.when(doc % 3 == 0, F.array(F.lit("x"), "source")).otherwise(none).alias("key_terms"))
    return chunking.lecture_summary(lectures).select("doc_id", "text")


@query("""WITH placed AS (SELECT conv_id, text, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
windows AS (SELECT DISTINCT conv_id, unnest(range(0, CAST(greatest(0, ceil((n - 6) / 4.0)) AS BIGINT) + 1)) AS window_index FROM placed)
SELECT 'sliding' AS strategy, w.conv_id, CAST(w.window_index AS BIGINT) AS window_index, string_agg(coalesce(text, ''), ' ' ORDER BY place) AS text, NULL AS role
FROM windows w JOIN placed p ON p.conv_id = w.conv_id AND p.place BETWEEN w.window_index * 4 AND w.window_index * 4 + 5 GROUP BY w.conv_id, w.window_index UNION ALL SELECT 'turn', conv_id, turn, text, role FROM conversations""")
def c9_lecture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    windows = chunking.sliding_windows(turns, ["conv_id"], "turn").select("conv_id", F.col("window_index").cast("bigint").alias("window_index"), "text")
    alone = turns.select("conv_id", F.col("turn").cast("bigint").alias("window_index"), "text", "role")
    return chunking.lecture_chunks({"sliding": windows, "turn": alone})


@query()
def c10_title_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, by lines, of which those that look like headings are titles."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    elements = lines.withColumn("kind", F.when(tx.looks_like_section(F.col("text")), "Title").otherwise("NarrativeText")).withColumn("page", F.floor(F.col("at") / 40).cast("int"))
    return chunking.document_chunks(chunking.title_chunks(elements, "doc_id"), "doc_id").select("doc_id", "chunk", "section_title", "raw_text", "page_start", "page_end", "word_count")


LINE_ROWS = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents"


@query(f"""WITH e AS (SELECT doc_id, place // 4 AS chunk, place, text, ['Title', 'NarrativeText', 'Table', 'ListItem', 'Image'][place % 5 + 1] AS kind FROM ({LINE_ROWS})),
g AS (SELECT doc_id, chunk, min_by(text, place) FILTER (kind = 'Title') AS section_title, coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (kind <> 'Table'), '') AS raw_text, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (kind = 'Table'), '') AS tables_text,
count(*) FILTER (kind = 'Table') AS table_count, count(*) FILTER (kind = 'Image') AS image_count, count(*) FILTER (kind = 'ListItem') AS list_item_count, string_agg(kind, ',' ORDER BY place) AS element_types FROM e GROUP BY doc_id, chunk)
SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN coalesce(section_title, '') <> '' THEN '[SECTION: ' || section_title || ']' END, nullif(trim(raw_text), ''), CASE WHEN tables_text <> '' THEN '[TABLE: ' || tables_text || ']' END) AS embedding_text, len({WORDS.format("raw_text")}) AS word_count, substr(raw_text, 1, 300) AS text_preview FROM g""")
def c11_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements of five kinds, four to a chunk."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    elements = lines.withColumn("chunk", F.floor(F.col("at") / 4)).withColumn("kind", pick(("Title", "NarrativeText", "Table", "ListItem", "Image"), F.col("at") % 5)).withColumn("page", F.lit(None).cast("int"))
    return chunking.document_chunks(elements, "doc_id").drop("page_start", "page_end").withColumn("element_types", F.array_join("element_types", ","))


@query(rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS parts,
list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS lines FROM documents),
f AS (SELECT doc_id, parts, list_reduce(list_transform(lines, lambda l: {{'done': []::VARCHAR[], 'now': l}}),
  lambda s, r: CASE WHEN regexp_matches(r.now, '[.!?;:]$') OR len({WORDS.format("CASE WHEN s.now = '' THEN r.now ELSE s.now || ' ' || r.now END")}) >= 90 THEN {{'done': list_append(s.done, CASE WHEN s.now = '' THEN r.now ELSE s.now || ' ' || r.now END), 'now': ''}}
  ELSE {{'done': s.done, 'now': CASE WHEN s.now = '' THEN r.now ELSE s.now || ' ' || r.now END}} END, {{'done': []::VARCHAR[], 'now': ''}}) AS m FROM d),
p AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN parts WHEN m IS NULL THEN [] WHEN m.now <> '' THEN list_append(m.done, m.now) ELSE m.done END AS ps FROM f)
SELECT doc_id, unnest(range(len(ps))) AS place, unnest(ps) AS text FROM p""")
def c12_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.col("at").alias("place"), "text")


EST = "greatest(1, CAST(floor({0} * CAST(1.3 AS DOUBLE)) AS BIGINT))"


@query(f"""WITH w AS (SELECT conv_id, list({{'made': []::STRUCT(t VARCHAR, n BIGINT)[], 't': coalesce(text, ''), 'n': len({WORDS.format("text")})}} ORDER BY turn) AS rows FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, list_reduce(rows, lambda s, r: CASE WHEN len(s.made) > 0 AND {EST.format("r.n")} < 120 AND {EST.format("(s.made[-1].n + r.n)")} <= 160 THEN {{'made': list_append(s.made[1:len(s.made) - 1], {{'t': s.made[-1].t || chr(10) || chr(10) || r.t, 'n': s.made[-1].n + r.n}}), 't': '', 'n': 0}}
ELSE {{'made': list_append(s.made, {{'t': r.t, 'n': r.n}}), 't': '', 'n': 0}} END, {{'made': []::STRUCT(t VARCHAR, n BIGINT)[], 't': '', 'n': 0::BIGINT}}).made AS made FROM w)
SELECT conv_id, unnest(range(len(made))) AS window_no, unnest(list_transform(made, lambda x: x.t)) AS text, unnest(list_transform(made, lambda x: x.n)) AS n_words FROM m""")
def c16_merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.merged_windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", 60, 100).withColumnRenamed("window", "window_no")


@query(f"""WITH u AS (SELECT conv_id, turn // 4 AS win, turn AS place, coalesce(text, '') AS text, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 5 * 10 END AS confidence FROM conversations),
g AS (SELECT conv_id, win, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text, round(avg(CASE WHEN confidence > 0 THEN confidence END), 2) AS confidence FROM u GROUP BY conv_id, win), w AS (SELECT *, {WORDS.format("lower(text)")} AS ws FROM g)
SELECT conv_id, win, text, confidence, length(text) AS char_count, len(ws) AS word_count, len(string_split(text, chr(10))) AS line_count, {EST.format("len(ws)")} AS token_count, round(len(list_distinct(list_filter(ws, lambda x: regexp_full_match(x, '\\p{{L}}+')))) / greatest(len(ws), 1), 3) AS semantic_density FROM w""")
def c17_window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, none = F.col("turn"), F.array().cast("array<string>")
    units = table(spark, sf_dir, "conversations").select("conv_id", F.floor(turn / 4).alias("win"), turn.alias("at"), F.coalesce("text", F.lit("")).alias("text"), F.when(turn % 3 == 0, 0).otherwise(turn % 5 * 10).alias("confidence"), none.alias("warnings"), none.alias("stages"), turn.alias("page"))
    return chunking.window_metadata(units, ["conv_id", "win"]).drop("warnings", "stages", "page_numbers")


@query()
def c23_transcript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third video has chapters."""
    turns = table(spark, sf_dir, "conversations")
    marks = turns.where("conv_id % 3 = 0 and turn % 3 = 0").select("conv_id", F.col("turn").alias("chapter_start"), F.concat(F.lit("part "), F.col("turn").cast("string")).alias("title"))
    return chunking.transcript_chunks(turns.select("conv_id", F.col("turn").alias("start"), "text"), marks, "conv_id")


@query("""WITH m AS (SELECT user_id, list_sort(list_distinct(list(CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 OR event_id % 5 <> 0 THEN 'flash' ELSE 'pro' END))) AS models FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(models) > 1 THEN 'mixed' ELSE coalesce(models[1], 'unknown') END AS model FROM m""")
def c27_model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    found = table(spark, sf_dir, "events").select("user_id", F.when(event % 7 == 0, None).when((user % 3 == 0) | (event % 5 != 0), "flash").otherwise("pro").alias("model"))
    return ocr.model_tag(found, ["user_id"])


@query("""WITH p AS (SELECT doc_id, text, doc_id % 100 AS confidence, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN ' ' ELSE 'better ' || doc_id END AS given FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(given, '')) <> '' THEN given ELSE text END AS text, confidence, CASE WHEN trim(coalesce(given, '')) = '' THEN 'ocr' WHEN confidence < 60 THEN 'image' ELSE 'text' END AS used, CASE WHEN trim(coalesce(given, '')) = '' THEN 'enrichment failed' ELSE '' END AS warnings FROM p""")
def c30_enriched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", (doc % 100).alias("confidence"))
    given = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id", F.when(doc % 9 == 0, " ").otherwise(F.concat(F.lit("better "), doc.cast("string"))).alias("text"))
    return ocr.enriched(pages, given, ["doc_id"]).withColumn("warnings", F.array_join("warnings", ","))


@query("""SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS text FROM conversations) WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id""")
def c33_full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")))
    return ocr.full_text(pages, "conv_id", "turn")


@query(f"""SELECT doc_id, substr(coalesce(text, ''), 1, 300) AS preview, len({WORDS.format("text")}) AS n_words FROM documents ORDER BY doc_id LIMIT 20""")
def c34_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.preview(table(spark, sf_dir, "documents"), id="doc_id")


PAGE_ELEMENTS = (r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<(h[1-6]|p|li|td|th|pre|blockquote)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(h[1-6]|p|li|td|th|pre|blockquote|div|ul|ol|table|article|section)\s*>', chr(1) || chr(2), 'g'), '<[^>]*>', ' ', 'g') AS t FROM b),
p AS (SELECT page_id, unnest(string_split(t, chr(1))) AS raw, unnest(range(len(string_split(t, chr(1))))) AS part FROM m),
e AS (SELECT page_id, part, lower(regexp_extract(raw, '^([A-Za-z0-9]*)' || chr(2), 1)) AS tag, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '^[A-Za-z0-9]*' || chr(2), ''), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS text FROM p)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS place, CASE WHEN starts_with(tag, 'h') THEN 'Title' WHEN tag = 'li' THEN 'ListItem' WHEN tag IN ('td', 'th') THEN 'Table' WHEN tag = 'pre' THEN 'Code' ELSE 'NarrativeText' END AS kind, text FROM e WHERE text <> ''""")


@query(PAGE_ELEMENTS)
def s5_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_elements(table(spark, sf_dir, "pages")).withColumnRenamed("at", "place")


@query(PAGE_ELEMENTS)
def s5_tree_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.tree_elements(table(spark, sf_dir, "pages")).select("page_id", F.col("at").alias("place"), "kind", "text")


TEXT_LINES = r"""lines AS (SELECT doc_id, generate_subscripts(l, 1) AS place, trim(unnest(l), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, regexp_matches(line, '^([-*•]|[0-9]{1,3}[.)])[ \t]+[^ \t\r\x0b\x0c]') AS item, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY place), '') = '' AS first FROM lines),
grouped AS (SELECT *, sum(CASE WHEN item OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS part FROM marked WHERE line <> ''),
parts AS (SELECT doc_id, part, bool_or(item) AS item, count(*) AS n, trim(regexp_replace(string_agg(CASE WHEN item THEN regexp_replace(line, '^([-*•]|[0-9]{1,3}[.)])[ \t]+', '') ELSE line END, ' ' ORDER BY place), '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS text FROM grouped GROUP BY doc_id, part)"""


@query(f"""WITH {TEXT_LINES}
SELECT CASE WHEN item THEN 'ListItem' WHEN n = 1 AND regexp_matches(text, '^\\p{{Lu}}') AND NOT regexp_matches(text, '[.!?,;:]$') AND len(string_split(text, ' ')) <= 12 THEN 'Title' ELSE 'NarrativeText' END AS kind, text FROM parts""")
def s5_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, which are read again in parts of 1 MB."""
    folder = writers.kept_path(spark, "texts")
    table(spark, sf_dir, "documents").where("text is not null").select(F.concat("text", F.lit("\n"))).write.text(folder)
    return files.read_elements(spark, folder, splitBytes=1 << 20, partitionBytes=1 << 20).select("kind", "text")


@query("SELECT doc_id, 1 AS page, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def s4_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one file each by their tasks, which are read again as pages."""
    folder = writers.kept_path(spark, "files")

    def save(batches):
        for batch in batches:
            for doc, text in zip(*batch.to_pydict().values()):
                with files.created(f"{folder}/{doc % 64}/{doc}.txt") as out:
                    out.write(text.encode())
            yield batch.slice(0, 0)

    table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInArrow(save, "doc_id long, text string").count()
    pages = files.read_pages(spark, folder).where("error is null")
    return pages.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "page", "text")


# --- ranking ---------------------------------------------------------------------------------

@query("""WITH f AS (SELECT doc_id, ['qna', 'image', 'audio', 'youtube', 'documents', 'handwritten'][doc_id % 6 + 1] AS source, doc_id % 4 - 1 AS marks, doc_id % 5 - 1 AS year, doc_id % 3 = 0 AS eq, (doc_id % 10) / 10.0 AS conf, doc_id % 2 = 0 AS told FROM documents)
SELECT doc_id, round(CAST(CASE source WHEN 'qna' THEN CASE WHEN marks > 0 THEN 1.12 ELSE 1 END * CASE WHEN year > 0 THEN 1.05 ELSE 1 END * CASE WHEN told THEN 1.10 ELSE 1 END
WHEN 'handwritten' THEN CASE WHEN eq AND told THEN 1.15 ELSE 1 END * CASE WHEN eq THEN 1.08 ELSE 1 END * CASE WHEN conf < 0.6 THEN 0.85 ELSE 1 END WHEN 'image' THEN CASE WHEN conf * 100 / 100 < 0.65 THEN 0.8 ELSE 1 END * CASE WHEN eq AND told THEN 1.12 ELSE 1 END
WHEN 'audio' THEN CASE WHEN eq THEN 1.08 ELSE 1 END * CASE WHEN conf < 0.7 THEN 0.9 ELSE 1 END WHEN 'documents' THEN CASE WHEN eq AND told THEN 1.1 ELSE 1 END ELSE 1 END AS DOUBLE), 6) AS boost FROM f""")
def r9_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    eq, conf = doc % 3 == 0, (doc % 10) / 10
    chunks = table(spark, sf_dir, "documents").select(
        "doc_id", pick(ranking.SOURCES, doc % 6).alias("source"), (doc % 4 - 1).alias("marks_hint"), (doc % 5 - 1).alias("year_hint"), F.lit("single_qa").alias("chunk_type"), eq.alias("has_equations"), F.when(eq, "equation").alias("content_type"),
        conf.alias("confidence"), (conf * 100).alias("ocr_confidence"), eq.alias("has_formula"), F.when(eq, "concept_block").alias("strategy"), conf.alias("avg_confidence"), eq.alias("has_table"),
        F.when(doc % 2 == 0, F.array(F.lit("Exam equation table"))).alias("signals"))
    return chunks.select("doc_id", F.round(ranking.metadata_boost(F.col("source"), F.col("signals")), 6).alias("boost"))


@query(f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 12), c AS (SELECT query_id, source, count(*) AS n FROM top GROUP BY ALL)
SELECT query_id, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM c GROUP BY query_id""")
def r15_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    top = vectors.dense_top_k(queries, chunks, 12).join(chunks.select("chunk_id", "source"), "chunk_id")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return ranking.breakdown(top, ["query_id"]).withColumn("sources", shown)


@query(f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 4)
SELECT query_id, string_agg('[' || rank || '] ' || source || ' | passage | score ' || CAST(CAST(rank AS DOUBLE) AS VARCHAR) || chr(10) || 'chunk ' || chunk_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY query_id""")
def r18_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    top = vectors.dense_top_k(queries, chunks, 4).join(chunks.select("chunk_id", "source"), "chunk_id")
    shown = top.select("query_id", "rank", F.col("source").alias("citation"), F.lit("passage").alias("chunk_type"), F.col("rank").cast("double").alias("score"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("display_text"))
    return ranking.context(shown, ["query_id"])


@query(f"""WITH {PLANNED}, b AS (SELECT *, CASE source WHEN 'qna' THEN 5 WHEN 'image' THEN 4 WHEN 'audio' THEN 2 WHEN 'youtube' THEN 0 WHEN 'documents' THEN 5 ELSE 2 END AS bm25_k FROM planned)
SELECT query_id, source, CAST(least(CASE WHEN bm25_k > 0 THEN dense_k * 3 ELSE dense_k END, 40) AS BIGINT) AS fetch_k FROM b""")
def r6_fetch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_plans(spark, sf_dir).select("query_id", "source", ranking.fetch_size(F.col("dense_k"), F.col("bm25_k")).cast("bigint").alias("fetch_k"))


ALIKE = "CASE WHEN a[i].f = a[j].f AND abs(a[i].p - a[j].p) <= 2 THEN 0.85 WHEN a[i].f = a[j].f THEN 0.5 ELSE a[i].score * a[j].score END"


@query(f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20),
packed AS (SELECT query_id, list({{'score': score, 'id': chunk_id, 'f': chunk_id % 7, 'p': chunk_id // 7}} ORDER BY rank) AS a FROM top GROUP BY query_id),
chosen AS (SELECT query_id, a, list_reduce(list_transform(range(2, 9), lambda x: {{'c': [x]}}), lambda s, x: {{'c': list_append(s.c, list_sort(list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(s.c, i)),
  lambda i: {{'v': -(0.6 * a[i].score - 0.4 * greatest(list_max(list_transform(s.c, lambda j: {ALIKE})), 0)), 'i': i}}))[1].i)}}, {{'c': [1::BIGINT]}}).c AS c FROM packed)
SELECT query_id, unnest(list_transform(c, lambda i: a[i].id)) AS chunk_id, unnest(range(1, len(c) + 1)) AS mmr_rank FROM chosen""")
def r8_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    found = vectors.dense_top_k(queries, chunks, 20)
    told = found.withColumn("source_file", (F.col("chunk_id") % 7).cast("string")).withColumn("file_name", F.concat(F.lit("f"), (F.col("chunk_id") % 7).cast("string"))).withColumn("place", F.floor(F.col("chunk_id") / 7).cast("int"))
    return ranking.diverse(told, ["query_id"], F.lit(8), F.lit(0.6)).select("query_id", "chunk_id", "mmr_rank")


@query(f"""WITH u AS (SELECT conv_id, list({{'kept': []::VARCHAR[][], 'w': list_distinct({TOKENS.format("text")})}} ORDER BY turn) AS rows FROM conversations WHERE role = 'user' GROUP BY conv_id),
k AS (SELECT conv_id, len(rows) AS n_asked, list_reduce(rows, lambda s, r: CASE WHEN len(list_filter(s.kept, lambda k: len(k) > 0 AND len(r.w) > 0 AND len(list_intersect(k, r.w)) / len(list_distinct(list_concat(k, r.w))) >= 0.72)) > 0 THEN s ELSE {{'kept': list_append(s.kept, r.w), 'w': []::VARCHAR[]}} END, {{'kept': []::VARCHAR[][], 'w': []::VARCHAR[]}}) AS s FROM u)
SELECT conv_id, n_asked, len(s.kept) AS n_kept, round(len(s.kept) / n_asked, 6) AS dedup_rate FROM k""")
def r3_m10_distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    kept = ranking.distinct_questions(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))))
    counted = asked.select("conv_id", F.size("rows").alias("n_asked"), F.size(kept).alias("n_kept"))
    return metrics.dedup_rate(counted).withColumn("dedup_rate", F.round("dedup_rate", 6))


@query()
def r13_sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with two sub-queries: its own vector and its neighbour's."""
    queries, chunks = vectors_of(spark, sf_dir)
    asked = queries.select("query_id", F.concat(F.lit("compare the steps of topic "), F.col("label").cast("string")).alias("query"), F.lit("ask").alias("mode"), "embedding")
    near = chunks.where("chunk_id % 100 = 1").select((F.col("chunk_id") - 1).alias("query_id"), F.lit(1).alias("sub"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("query"), "embedding")
    subs = asked.select("query_id", F.lit(0).alias("sub"), "query", "embedding").unionByName(near)
    told = chunks.withColumn("text", F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" part "), F.col("chunk_id").cast("string"))).drop("label")
    return planner.retrieve(asked.drop("mode"), planner.plan(asked.drop("embedding")), told, sub_queries=subs)


# --- cache -----------------------------------------------------------------------------------

@query("""SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click'""")
def h4_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.without_course(table(spark, sf_dir, "events").withColumn("course", F.col("event_type")), "click").select("event_id")


@query("""SELECT m.mode, count(e.event_id) AS n FROM (VALUES ('ask'), ('quiz'), ('summarize')) m(mode) LEFT JOIN events e ON m.mode = CASE WHEN event_id % 3 = 0 THEN 'ask' WHEN event_id % 3 = 1 THEN 'quiz' END GROUP BY m.mode""")
def h5_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 3 == 0, "ask").when(F.col("event_id") % 3 == 1, "quiz")
    return cache.stats(table(spark, sf_dir, "events").select(mode.alias("mode")))


@query("""SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'documents' END AS source, CASE WHEN doc_id % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS score, 1 AS rank, coalesce(text, '') AS text, '' AS citation FROM documents""")
def h6_rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    chunk = F.struct(doc.cast("string").alias("chunk_id"), F.when(doc % 2 == 0, F.col("source")).alias("source"), F.when(doc % 3 == 0, 0.5).alias("score"), F.col("text").alias("display_text"))
    entries = table(spark, sf_dir, "documents").select(F.concat(F.lit("e"), doc.cast("string")).alias("entry_id"), F.to_json(F.array(chunk)).alias("chunks"))
    hits = table(spark, sf_dir, "documents").select(doc.alias("query_id"), F.concat(F.lit("e"), doc.cast("string")).alias("entry_id"))
    return cache.rehydrated(hits, entries)


# --- courses ---------------------------------------------------------------------------------

@query(f"WITH {SCHOOL} SELECT course_id, title, course_id IN (SELECT course_id FROM enrolments WHERE user_id = 7) AS enrolled FROM courses")
def j9_marked_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    return relational.marked_catalog(s["courses"], s["enrolments"], 7).select("course_id", "title", "enrolled")


@query(f"WITH {SCHOOL} SELECT course_id, title FROM courses ORDER BY course_id % 37 DESC, course_id")
def j2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = school(spark, sf_dir)["courses"].withColumn("created_at", F.col("course_id") % 37)
    return relational.catalog(courses).select("course_id", "title")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC")
def j7_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.listed(table(spark, sf_dir, "orders"), "o_orderdate", o_custkey=7, o_orderstatus="O").select("o_orderkey", "o_orderdate")


@query("""SELECT vec_id, label, len(embedding) AS width FROM embeddings""")
def j13_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return chunking.zipped(own.select("vec_id", "label"), own.select("vec_id", "embedding"), "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


@query("""SELECT c_custkey, 'u' || c_custkey AS email FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 50 >= 20 AND c_custkey % 3 <> 0""")
def j15_open_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    email = F.concat(F.lit("u"), key.cast("string"))
    codes = table(spark, sf_dir, "customer").select(email.alias("email"), (key * 7).alias("code"), (key % 50).alias("expires"), (key % 3 == 0).alias("verified"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"), F.when(key % 4 == 0, key).otherwise(key * 7).alias("code"))
    return relational.open_codes(codes, asked, F.lit(20)).select("c_custkey", "email")


# --- evaluation ------------------------------------------------------------------------------

@query(f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20),
grades AS (SELECT query_id, chunk_id, chunk_id % 4 AS grade FROM scored WHERE label = query_label AND chunk_id % 4 > 0),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM grades) GROUP BY query_id),
m AS (SELECT t.query_id, sum(CASE WHEN rank <= 10 THEN coalesce(grade, 0) / log2(rank + 1) ELSE 0 END) AS dcg FROM top t LEFT JOIN grades g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id GROUP BY t.query_id)
SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM m LEFT JOIN ideal USING (query_id)""")
def m3_linear_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    grades = queries.select("query_id", "label").join(chunks.where("chunk_id % 4 > 0").select("chunk_id", "label"), "label").select("query_id", "chunk_id", (F.col("chunk_id") % 4).alias("grade"))
    found = metrics.retrieval(vectors.dense_top_k(queries, chunks, 20), grades, ["query_id"], 10, linear=True)
    return found.select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("""WITH s AS (SELECT event_id, list_slice(['a', 'b', 'c', 'd'], 1, event_id % 5) AS found, list_slice(['b', 'd', 'e'], 1, event_id % 4) AS expected FROM events)
SELECT event_id, round(CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_intersect(found, expected)) / len(expected) END, 6) AS source_coverage FROM s""")
def m7_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, every = F.col("event_id"), lambda *v: F.array(*map(F.lit, v))
    own = table(spark, sf_dir, "events").select("event_id", F.slice(every("a", "b", "c", "d"), 1, event % 5).alias("found"), F.slice(every("b", "d", "e"), 1, event % 4).alias("expected"))
    return metrics.source_coverage(own, "found", "expected").select("event_id", F.round("source_coverage", 6).alias("source_coverage"))


@query("""WITH s AS (SELECT event_id, list_slice(['a', 'b', 'c', 'd'], 1, event_id % 5) AS planned, list_slice(['b', 'd', 'e'], 1, event_id % 4) AS expected, list_slice(['c', 'a'], 1, event_id % 3) AS excluded FROM events),
n AS (SELECT *, len(planned) AS p, len(expected) AS e, len(list_intersect(planned, expected)) AS good, len(list_intersect(planned, excluded)) AS bad FROM s)
SELECT event_id, round(CASE WHEN p = 0 THEN 0 ELSE greatest(good / p - bad / p, 0) END, 4) AS precision, round(CASE WHEN p = 0 THEN 0 WHEN e = 0 THEN 1 ELSE good / e END, 4) AS recall FROM n""")
def m30_planner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, upto = F.col("event_id"), lambda n, *v: F.slice(F.array(*map(F.lit, v)), 1, n)
    own = table(spark, sf_dir, "events").select("event_id", upto(event % 5, "a", "b", "c", "d").alias("planned"), upto(event % 4, "b", "d", "e").alias("expected"), upto(event % 3, "c", "a").alias("excluded"))
    return metrics.planner_selection(own).select("event_id", "precision", "recall")


@query("""SELECT event_id, round(coalesce(least(value / nullif(event_id % 90, 0), 1), 0), 6) AS planner_ratio FROM events""")
def m10_planner_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(metrics.planner_ratio(F.col("value"), (F.col("event_id") % 90).cast("double")), 6).alias("planner_ratio"))


@query(r"""WITH c AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(text || ' [' || (turn % 3) || '] [2] [' || (conv_id % 4) || ']', '\[(\d{1,9})\]', 1), lambda x: CAST(x AS INT))) AS cite FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, turn, cite, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT conv_id, turn, n / sum(n) OVER (PARTITION BY conv_id, turn) AS p FROM n)
SELECT conv_id, turn, round(sum(-p * log2(p)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 6) AS balance FROM p GROUP BY conv_id, turn""")
def m25_attribution_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
    own = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.concat("text", cite(F.col("turn") % 3), F.lit(" [2]"), cite(F.col("conv_id") % 4)).alias("answer"))
    return metrics.attribution_balance(own, ["conv_id", "turn"]).withColumn("balance", F.round("balance", 6))


@query("""SELECT avg(value) >= 40 AS value_ok, avg(user_id) <= 10 AS user_id_ok, avg(value) >= 40 AND avg(user_id) <= 10 AS healthy FROM events""")
def m33_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.health(table(spark, sf_dir, "events"), {"value": 40}, {"user_id": 10})


@query(f"WITH {PLANNED} SELECT mode, source, round(avg(round(CAST(weight AS DOUBLE), 4)), 6) AS weight FROM planned GROUP BY mode, source")
def m34_source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_weights(asked_plans(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def evaluated(columns: str, least: int, most: int, fields: dict[str, str], rates: dict[str, str], kind: str) -> str:
    """The SQL of a source's evaluation over documents."""
    value = lambda name, sql: f"SELECT '{name}' AS metric, CAST({sql} AS DOUBLE) AS value FROM c"
    size = {"n": "count(*)", "mean": "avg(size)", "sd": "coalesce(stddev_samp(size), 0)", "min": "min(size)", "max": "max(size)", "p5": "quantile_cont(size, 0.05)", "p95": "quantile_cont(size, 0.95)", "under_rate": f"avg((size < {least})::INT)", "over_rate": f"avg((size > {most})::INT)"}
    rows = [value(n, s) for n, s in size.items()] + [value(f"filled:{n}", f"avg(({t})::INT)") for n, t in fields.items()] + [value(n, f"avg(coalesce({t}, false)::INT)") for n, t in rates.items()]
    rows.append(f"SELECT 'share:' || coalesce({kind}, 'none'), count(*) / (SELECT count(*) FROM c) FROM c GROUP BY {kind}")
    return f"""WITH c AS (SELECT *, {EST.format("len(" + WORDS.format("text") + ")")} AS size FROM (SELECT doc_id, text, source, lang, {columns} FROM documents)), r AS ({" UNION ALL ".join(rows)}) SELECT metric, round(value, 6) AS value FROM r"""


FILLED = "{0} IS NOT NULL AND {0} <> ''"


def evaluation(spark: SparkSession, sf_dir: str, source: str, **columns: object) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_file"), F.col("lang").alias("lang"))
    return metrics.source_evaluation(docs.withColumns(columns), source).withColumn("value", F.round("value", 6))


@query(evaluated("CASE WHEN doc_id % 3 = 0 THEN 'single_qa' WHEN doc_id % 3 = 1 THEN 'multi_qa' END AS chunk_type, doc_id % 4 AS na, doc_id % 5 - 1 AS year_hint, CASE WHEN doc_id % 2 = 0 THEN 3 END AS marks_hint", 20, 800, {"text": FILLED.format("text"), "chunk_type": "chunk_type IS NOT NULL", "questions": "na > 0"},
                 {"qa_rate": "chunk_type IS NOT NULL", "answers_rate": "na > 1", "year_rate": "year_hint > 0", "marks_rate": "marks_hint > 0"}, "chunk_type"))
def m15_evaluate_qna(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    some = lambda test: F.when(test, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return evaluation(spark, sf_dir, "qna", chunk_type=F.when(doc % 3 == 0, "single_qa").when(doc % 3 == 1, "multi_qa"), questions=some(doc % 4 > 0), answers=some(doc % 4 > 1), year_hint=doc % 5 - 1, marks_hint=F.when(doc % 2 == 0, 3))


@query(evaluated("CASE WHEN doc_id % 3 = 0 THEN 'concept_block' ELSE 'sliding' END AS strategy, doc_id % 10 / 10.0 AS conf, doc_id % 7 = 0 AS unclear", 30, 600, {"text": FILLED.format("text"), "lecture_title": FILLED.format("lang"), "strategy": "true"},
                 {"low_confidence_rate": "conf < 0.7", "concept_rate": "strategy = 'concept_block'", "unclear_rate": "unclear"}, "strategy"))
def m16_evaluate_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return evaluation(spark, sf_dir, "audio", lecture_title=F.col("lang"), strategy=F.when(doc % 3 == 0, "concept_block").otherwise("sliding"), avg_confidence=doc % 10 / 10, has_unclear_segments=doc % 7 == 0)


@query(evaluated("doc_id % 3 = 0 AS t, doc_id % 4 = 0 AS i, doc_id % 5 = 0 AS l, CASE WHEN doc_id % 6 > 0 THEN 'k' || (doc_id % 6) END AS kind", 40, 900, {"text": FILLED.format("text"), "section_title": FILLED.format("lang"), "source_file": FILLED.format("source")},
                 {"table_rate": "t", "image_rate": "i", "list_rate": "l"}, "kind"))
def m17_evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return evaluation(spark, sf_dir, "documents", section_title=F.col("lang"), has_table=doc % 3 == 0, has_image=doc % 4 == 0, has_list=doc % 5 == 0, element_type=F.when(doc % 6 > 0, F.concat(F.lit("k"), (doc % 6).cast("string"))))


@query(evaluated("'t' || (doc_id % 4) AS image_type, doc_id % 100 AS conf, doc_id % 3 = 0 AS code, doc_id % 4 = 0 AS formula, doc_id % 5 > 0 AS linked", 25, 500, {"text": FILLED.format("text"), "image_type": "true", "source_file": FILLED.format("source")},
                 {"low_confidence_rate": "conf < 80", "code_rate": "code", "formula_rate": "formula", "linked_rate": "linked"}, "image_type"))
def m18_evaluate_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return evaluation(spark, sf_dir, "image", image_type=F.concat(F.lit("t"), (doc % 4).cast("string")), ocr_confidence=(doc % 100).cast("double"), has_code=doc % 3 == 0, has_formula=doc % 4 == 0, prev_chunk_id=F.when(doc % 5 == 1, "p"), next_chunk_id=F.when(doc % 5 > 1, "n"))


@query(evaluated("CASE WHEN doc_id % 3 = 0 THEN 'a flash' WHEN doc_id % 3 = 1 THEN 'Pro' END AS model, CASE WHEN doc_id % 4 = 0 THEN 'good' ELSE 'poor' END AS ink, doc_id % 5 = 0 AS eq", 20, 700, {"text": FILLED.format("text"), "topic": FILLED.format("lang"), "source_file": FILLED.format("source")},
                 {"flash_rate": "contains(lower(model), 'flash')", "pro_rate": "contains(lower(model), 'pro')", "good_ink_rate": "ink = 'good'", "equation_rate": "eq"}, "lang"))
def m19_evaluate_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return evaluation(spark, sf_dir, "handwritten", topic=F.col("lang"), content_type=F.col("lang"), model_used=F.when(doc % 3 == 0, "a flash").when(doc % 3 == 1, "Pro"), ink_quality=F.when(doc % 4 == 0, "good").otherwise("poor"), has_equations=doc % 5 == 0)


@query(evaluated("CASE WHEN doc_id % 3 = 0 THEN 'Unknown' WHEN doc_id % 3 = 1 THEN 'One' ELSE '' END AS chapter, doc_id % 4 > 0 AS linked, doc_id % 5 = 0 AS generated", 60, 550, {"text": FILLED.format("text"), "video_title": FILLED.format("source"), "chapter_title": FILLED.format("chapter")},
                 {"chapter_rate": "chapter NOT IN ('', 'Unknown')", "deep_link_rate": "linked", "manual_rate": "NOT generated"}, "chapter"))
def m20_evaluate_youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return evaluation(spark, sf_dir, "youtube", video_title=F.col("source_file"), chapter_title=F.when(doc % 3 == 0, "Unknown").when(doc % 3 == 1, "One").otherwise(""), deep_link=F.when(doc % 4 > 0, "x").otherwise(""), is_generated_transcript=doc % 5 == 0)


SENTENCES = r"list_filter(string_split(regexp_replace(coalesce({0}, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
ANSWER_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-zA-Z0-9_]{{3,}}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in tx.ANSWER_STOPWORDS) + ")))"


@query(rf"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') || ' [1] and [3].' AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations),
a AS (SELECT *, list_filter({SENTENCES.format("answer")}, lambda s: len({WORDS.format("s")}) >= 4) AS long, {ANSWER_WORDS.format("context")} AS known, len({WORDS.format("answer")}) AS nw FROM t WHERE role = 'assistant')
SELECT conv_id, turn, round(len(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1), lambda c: CAST(c AS INT)), lambda c: c BETWEEN 1 AND 3))) / 3, 6) AS context_utilisation,
round(CASE WHEN len(long) = 0 THEN 0 ELSE len(list_filter(long, lambda s: regexp_matches(s, '\[\d+\]'))) / len(long) END, 6) AS citation_coverage, nw BETWEEN 40 AND 350 AS length_ok,
(contains(lower(answer), 'tion')::INT + contains(lower(answer), 'zzz')::INT) / 2 AS keyword_recall, round(CASE WHEN len(long) = 0 THEN 0 ELSE len(list_filter(long, lambda s: len(list_intersect({ANSWER_WORDS.format("s")}, known)) = 0)) / len(long) END, 6) AS hallucination,
(regexp_matches(answer, '(?m)^[\-\*]\s')::INT + regexp_matches(answer, '•\s')::INT) / 2 AS plan_alignment FROM a""")
def m21_m27_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("context", F.coalesce(F.lag("text").over(own), F.lit(""))).where("role = 'assistant'")
    asked = turns.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" [1] and [3].")).alias("answer"), "context", F.lit(3).alias("n_chunks"), F.array(F.lit("tion"), F.lit("zzz")).alias("keywords"), F.lit("short").alias("length"), F.lit("bullet_summary").alias("format"))
    found = metrics.answers(asked)
    return found.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("context_utilisation", "citation_coverage", "keyword_recall", "hallucination", "plan_alignment")], "length_ok")


@query(f"""WITH c AS (SELECT {SOURCE_NAMES}[doc_id % 6 + 1] AS source, text, source AS source_file, CASE WHEN doc_id % 4 > 0 THEN lang END AS topic, CASE WHEN doc_id % 5 > 0 THEN 'x' ELSE '' END AS section_title, {WORDS.format("text")} AS w, {WORDS.format("lower(text)")} AS l FROM documents),
f AS (SELECT source, (CASE WHEN coalesce(source_file, '') <> '' THEN 1 ELSE 0 END) AS f1, (CASE WHEN coalesce(topic, '') <> '' THEN 1 ELSE 0 END) AS f2, (CASE WHEN section_title <> '' THEN 1 ELSE 0 END) AS f3, len(w) BETWEEN 15 AND 2000 AS ok,
  CASE WHEN len(l) = 0 THEN 0 ELSE round(least(len(list_distinct(l)) / len(l) + CAST(0.1 AS DOUBLE), 1), 4) END AS rich FROM c),
g AS (SELECT source, ok, rich, round(CASE source WHEN 'qna' THEN (f2 + f1) / 3 WHEN 'image' THEN f1 / 2 WHEN 'audio' THEN 0 WHEN 'youtube' THEN 0 WHEN 'documents' THEN (f1 + f3) / 2 ELSE (f1 + f2) / 2 END, 4) AS filled FROM f)
SELECT source, count(*) AS total, round(avg(filled), 4) AS completeness, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS size_ok, round(avg(rich), 4) AS richness FROM g GROUP BY GROUPING SETS ((source), ())""")
def m35_live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(pick(ranking.SOURCES, doc % 6).alias("source"), "text", F.col("source").alias("source_file"), F.when(doc % 4 > 0, F.col("lang")).alias("topic"), F.when(doc % 5 > 0, "x").otherwise("").alias("section_title"))
    return live.chunking_report(chunks)


@query("""SELECT event_type AS stage, count(*) AS n, min(value) AS min, max(value) AS max, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY event_type""")
def m32_sketched_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of daily sketches, and whether the exact ranks of what they say are within the stated error."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "value", F.col("ts").cast("timestamp").alias("ts"))
    parts = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = live.percentiles(live.daily_sketches(events, ["stage"], "value"), ["stage"], parts)
    both = events.join(F.broadcast(found), "stage")
    share = lambda test: F.avg(test.cast("double"))
    near = [((share(F.col("value") < F.col(p)) - live.RANK_ERROR <= q) & (share(F.col("value") <= F.col(p)) + live.RANK_ERROR >= q)).alias(f"{p}_near") for p, q in parts.items()]
    return both.groupBy("stage", "n", "min", "max").agg(*near)


@query(f"""WITH {SCORED} SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank = 1""")
def r4_indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunk of every query by a stored index, which is trained and written here; what it finds is checked against all its cells."""
    queries, chunks = vectors_of(spark, sf_dir)
    path = writers.kept_path(spark, "index")
    vector_index.create(chunks, path)
    return vector_index.search(queries, path, 1, again=40, exact=True).select("query_id", "chunk_id", "score")


@query()
def r4_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by a stored index; recall is held against the exact search in tests/test_vector_index.py."""
    queries, chunks = vectors_of(spark, sf_dir)
    path = writers.kept_path(spark, "index")
    vector_index.create(chunks, path)
    return vector_index.search(queries, path, 5)


@query("""SELECT 'c' || (user_id % 3) AS course_id, CASE WHEN user_id % 2 = 0 THEN 'qna' ELSE 'documents' END AS namespace, 'u' || user_id AS chunk_id, max(event_id) AS version, arg_max(event_type, event_id) AS text FROM events GROUP BY user_id""")
def k3_bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's chunk, upserted in three parts into a table of buckets."""
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (user % 3).cast("string")).alias("course_id"), F.when(user % 2 == 0, "qna").otherwise("documents").alias("namespace"), F.concat(F.lit("u"), user.cast("string")).alias("chunk_id"), F.col("event_id").alias("version"), F.col("event_type").alias("text"))
    held = BucketTable.create(spark, writers.kept_path(spark, "buckets"), "course_id string, namespace string, chunk_id string, version long, text string", buckets=4)
    for part in (1, 0, 2):
        held.upsert(rows.where(F.col("version") % 3 == part))
    return held.read()


# --- budgets ---------------------------------------------------------------------------------

def bucket(capacity: float, rate: float, users: str = "true") -> str:
    """SQL of the level right before each event of the users of a condition: a fold over a user's events in order."""
    level = f"least({capacity}::DOUBLE, s.level + CASE WHEN s.last IS NULL THEN 0 ELSE (r.us - s.last) / 1e6 * {rate} END)"
    empty = "{'level': 0::DOUBLE, 'last': NULL::BIGINT, 'us': epoch_us(ts), 'tokens': greatest(floor(value * 1000), 0)::DOUBLE, 'id': event_id::BIGINT, 'seen': []::STRUCT(id BIGINT, level DOUBLE)[]}"
    return f"""SELECT user_id, unnest(list_reduce(list({empty} ORDER BY ts, event_id), lambda s, r: {{'level': greatest({level} - r.tokens, 0), 'last': r.us, 'us': 0::BIGINT, 'tokens': 0::DOUBLE, 'id': 0::BIGINT, 'seen': list_append(s.seen, {{'id': r.id, 'level': {level}}})}},
{{'level': {capacity}::DOUBLE, 'last': NULL::BIGINT, 'us': 0::BIGINT, 'tokens': 0::DOUBLE, 'id': 0::BIGINT, 'seen': []::STRUCT(id BIGINT, level DOUBLE)[]}}).seen) AS e FROM events WHERE {users} GROUP BY user_id"""


@query(f"""SELECT user_id, e.id AS event_id, round(e.level, 4) AS available FROM ({bucket(80_000, 0.5)})""")
def w2_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.bucket_levels(spending(spark, sf_dir), 80_000, 0.5).withColumn("available", F.round("available", 4))


@query(f"""WITH b AS ({bucket(80_000, 800.0, "user_id % 10 <> 0")} UNION ALL {bucket(250_000, 2500.0, "user_id % 10 = 0")}), e AS (SELECT event_id, user_id, event_type AS mode, ts, epoch_us(ts) AS us, CAST(floor(value * 1000) AS BIGINT) AS t FROM events),
u AS (SELECT *, coalesce(sum(greatest(t, 0)) OVER (PARTITION BY user_id, mode ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING), 0) AS used_window,
  coalesce(sum(greatest(t, 0)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_day FROM e),
j AS (SELECT u.*, b.e.level AS available, CASE WHEN u.user_id % 10 = 0 THEN 150000 ELSE 50000 END AS minute, CASE WHEN u.user_id % 10 = 0 THEN 2500 ELSE 800 END AS rate, CASE WHEN u.user_id % 10 = 0 THEN 2000000 ELSE 500000 END AS day FROM u JOIN b ON b.e.id = u.event_id),
d AS (SELECT *, CASE WHEN used_window >= minute THEN 'window' WHEN available < 1 THEN 'bucket' WHEN used_day >= day THEN 'day' END AS reason FROM j)
SELECT event_id, CAST(used_window AS BIGINT) AS used_window, CAST(used_day AS BIGINT) AS used_day, round(available, 4) AS available, reason IS NULL AS allowed, reason,
CAST(ceil(CASE reason WHEN 'window' THEN greatest(5.0, 60 * (used_window - minute) / used_window) WHEN 'bucket' THEN greatest(1.0, (500 - available) / rate) WHEN 'day' THEN 86400 - floor(epoch(ts)) % 86400 END) AS BIGINT) AS retry_after FROM d""")
def w4_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.decisions(spending(spark, sf_dir)).select("event_id", "used_window", "used_day", F.round("available", 4).alias("available"), "allowed", "reason", "retry_after")


@query("""SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS tokens FROM events WHERE event_id % 3 <> 0 AND floor(value * 1000) > 0""")
def w6_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.recorded(spending(spark, sf_dir).withColumn("ok", F.col("event_id") % 3 != 0)).select("event_id", "tokens")


@query("""SELECT event_id FROM events WHERE user_id % 4 <> 0""")
def w9_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spending(spark, sf_dir)
    return rate_limit.without_users(own, own.where("user_id % 4 = 0").select("user_id")).select("event_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type AS mode, epoch_us(ts) AS us, CAST(floor(value * 1000) AS BIGINT) AS t FROM events),
u AS (SELECT event_id, user_id, CAST(coalesce(sum(greatest(t, 0)) OVER (PARTITION BY user_id, mode ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used, CASE WHEN user_id % 10 = 0 THEN 150000 ELSE 50000 END AS minute FROM e)
SELECT event_id, '{"limit":' || minute || ',"used":' || used || ',"remaining":' || greatest(minute - used, 0) || ',"retry_after":' || (event_id % 9) || '}' AS headers FROM u""")
def w10_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = rate_limit.sliding_usage(spending(spark, sf_dir), 36_000).withColumn("retry_after", F.col("event_id") % 9)
    return rate_limit.headers(used).select("event_id", "headers")
