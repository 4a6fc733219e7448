"""The engine's own queries over the driver's tables, and the same in SQL.

Names begin with the operator's handle in the survey.  Each query reads its whole tables; searches
take the rows whose id is divisible by 100 as their queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import display
from ragloom.functions import text as tx
from ragloom.operators import cache, chunking, keywords, metrics, ocr, ranking, relational, vectors
from ragloom.plans import planner
from ragloom.sources import readers, writers
from ragloom.streaming import rate_limit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Whole numbers as bigint, as the SQL gives them."""
            found = f(spark, sf_dir)
            return found.select(*[F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in found.dtypes])

        QUERIES[f.__name__] = wide
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-zA-Z0-9_]{{2,}}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "))"
SOURCE_NAMES = "['qna', 'image', 'audio', 'youtube', 'documents', 'handwritten']"


# --- search and fusion -----------------------------------------------------------------------

def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, chunks): every vector is a chunk of the source that its label names, every hundredth a query."""
    own = table(spark, sf_dir, "embeddings")
    names = F.array(*map(F.lit, ranking.SOURCES))
    chunks = own.select(F.col("vec_id").alias("chunk_id"), F.get(names, F.col("label") % 6).alias("source"), "label", "embedding")
    return own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding"), chunks


COSINE = "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))"
SCORED = f"""
own AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {SOURCE_NAMES}[label % 6 + 1] AS source FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS chunk_id, c.source, c.label, round({COSINE}, 6) AS score FROM own q, own c WHERE q.vec_id % 100 = 0)"""


@query(f"""WITH {SCORED}
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5""")
def r4_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    return vectors.dense_top_k(queries, chunks, 5)


@query(f"""WITH {SCORED}
SELECT query_id, source, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE label >= 3) WHERE rank <= 3""")
def r5_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    return vectors.dense_top_k(queries, chunks, 3, by=["source"], where={"label": {"$gte": 3}})


def fused_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    lists = vectors.dense_top_k(queries, chunks, 10, by=["source"])
    numbers = F.create_map(*[F.lit(x) for i, s in enumerate(ranking.SOURCES) for x in (s, i)])
    ranked = lists.withColumn("weight", ranking.lookup(ranking.MODE_WEIGHTS["ask"], F.col("source"))).withColumn("boost", F.lit(1.0)).withColumn("list_no", F.element_at(numbers, F.col("source")))
    return ranking.fuse(ranked, ["query_id"])


FUSED = f"""{SCORED},
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10),
weighted AS (SELECT *, CASE source {" ".join(f"WHEN '{s}' THEN {w}" for s, w in ranking.MODE_WEIGHTS["ask"].items())} END AS weight, list_position({SOURCE_NAMES}, source) - 1 AS list_no FROM lists),
fused AS (SELECT query_id, chunk_id, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS rrf, min(list_no * 1000 + rank) AS first_seen FROM weighted GROUP BY query_id, chunk_id)"""


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf, 8) AS rrf, first_seen FROM fused")
def r10_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_lists(spark, sf_dir).select("query_id", "chunk_id", F.round("rrf", 8).alias("rrf"), "first_seen")


@query(f"""WITH {FUSED},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 10) DESC, first_seen, chunk_id) AS place FROM fused)
SELECT query_id, chunk_id, round(rrf, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 4) DESC, place) AS rank FROM top WHERE place <= 8""")
def r14_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: dense lists of six sources, fused by reciprocal rank, the eight best of each query."""
    return ranking.select_top(fused_lists(spark, sf_dir), ["query_id"], 8)


@query()
def r4_hashed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    return vectors.hashed_top_k(queries, chunks, 5)


@query()
def r2_sequential_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a run of 64 vectors."""
    own = table(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 64))
    return vectors.sequential_clusters(own, "doc", "vec_id").select("vec_id", "doc", "cluster")


@query(f"""WITH turns AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query, {TOKENS.format("text")} AS words FROM conversations),
sized AS (SELECT *, len(words) AS dl, count(*) OVER (PARTITION BY conv_id) AS n, avg(len(words)) OVER (PARTITION BY conv_id) AS avgdl FROM turns),
tf AS (SELECT conv_id, turn, dl, n, avgdl, term, count(*) AS tf FROM (SELECT *, unnest(words) AS term FROM sized) GROUP BY ALL),
df AS (SELECT conv_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY conv_id, term, n),
idf AS (SELECT conv_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY conv_id) ELSE raw END AS idf FROM df),
asked AS (SELECT conv_id, term, count(*) AS asked FROM (SELECT conv_id, unnest({TOKENS.format("query")}) AS term FROM (SELECT DISTINCT conv_id, query FROM turns)) GROUP BY ALL),
raw AS (SELECT conv_id, turn, sum(asked * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS raw FROM tf JOIN idf USING (conv_id, term) JOIN asked USING (conv_id, term) GROUP BY conv_id, turn),
every AS (SELECT conv_id, turn, coalesce(raw, 0) AS raw, max(coalesce(raw, 0)) OVER (PARTITION BY conv_id) AS top FROM turns LEFT JOIN raw USING (conv_id, turn)),
scored AS (SELECT conv_id, turn, round(CASE WHEN top > 0 THEN raw / top ELSE raw END, 6) AS bm25 FROM every)
SELECT conv_id, turn, bm25, row_number() OVER (PARTITION BY conv_id ORDER BY bm25 DESC, turn) AS bm25_rank FROM scored""")
def r7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation, ranked by the words of its first."""
    turns = table(spark, sf_dir, "conversations").withColumn("query", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return ranking.bm25(turns, ["conv_id"], chunk="turn", rank="turn").select("conv_id", "turn", "bm25", "bm25_rank")


@query()
def r20_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    asked = queries.select("query_id", F.concat(F.lit("compare the steps of topic "), F.col("label").cast("string")).alias("query"), F.lit("ask").alias("mode"), "embedding")
    told = chunks.withColumn("text", F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" part "), F.col("chunk_id").cast("string"))).drop("label")
    return planner.retrieve(asked.drop("mode"), planner.plan(asked.drop("embedding")), told)


ASKED = ["draw a diagram of it", "derive the law", "a worked example please", "compare both", "the steps of it", "what is it"]
PLANNED = """q AS (SELECT item_id AS query_id, item_id % 6 AS kind, ['ask', 'quiz', 'summarize'][item_id % 3 + 1] AS mode, ['basic', 'intermediate', 'advanced'][item_id % 4 % 3 + 1] AS complexity FROM benchmark),
base(source, ask, quiz, summ, lo, hi) AS (VALUES ('qna', 2.0, 2.8, 1.5, 4, 8), ('image', 1.2, 1.3, 1.2, 3, 6), ('audio', 1.8, 1.0, 2.0, 6, 12), ('youtube', 1.0, 0.8, 1.8, 5, 8), ('documents', 2.2, 1.8, 2.2, 5, 9), ('handwritten', 1.3, 1.5, 1.3, 3, 6)),
factor(kind, source, f) AS (VALUES (0, 'image', 1.5), (0, 'youtube', 1.2), (1, 'qna', 1.3), (1, 'handwritten', 1.4), (2, 'handwritten', 1.5), (2, 'qna', 1.3), (2, 'audio', 1.2), (3, 'documents', 1.3), (3, 'youtube', 1.2), (4, 'audio', 1.3), (4, 'youtube', 1.3)),
planned AS (SELECT q.*, b.source, CASE mode WHEN 'ask' THEN ask WHEN 'quiz' THEN quiz ELSE summ END * coalesce(f, 1) AS weight,
ceil(CASE complexity WHEN 'basic' THEN lo WHEN 'advanced' THEN hi ELSE (lo + hi) / 2.0 END * CASE WHEN mode = 'quiz' AND b.source = 'qna' THEN 1.5 WHEN mode = 'summarize' THEN 1.2 ELSE 1 END) AS dense_k FROM q CROSS JOIN base b LEFT JOIN factor f ON f.kind = q.kind AND f.source = b.source)"""


def asked_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every category, mode and complexity."""
    item = F.col("item_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n)
    return planner.plan(table(spark, sf_dir, "benchmark").select(item.alias("query_id"), pick(ASKED, item % 6).alias("query"), pick(("ask", "quiz", "summarize"), item % 3).alias("mode"), pick(("basic", "intermediate", "advanced"), item % 4 % 3).alias("complexity")))


@query(f"WITH {PLANNED} SELECT query_id, source, mode, round(CAST(weight AS DOUBLE), 4) AS weight, CAST(dense_k AS BIGINT) AS dense_k FROM planned")
def r17_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_plans(spark, sf_dir).select("query_id", "source", "mode", F.round("weight", 4).alias("weight"), "dense_k")


# --- texts -----------------------------------------------------------------------------------

@query(f"""SELECT doc_id, len({WORDS.format("text")}) AS n_words, greatest(1, CAST(floor(len({WORDS.format("text")}) * CAST(1.3 AS DOUBLE)) AS BIGINT)) AS tokens, CAST(floor(length(text) / 4) AS BIGINT) AS tokens_by_chars,
sha256(array_to_string({WORDS.format("lower(text)")}, ' ') || '|ask') AS hash, substr(sha256(lang || '::' || doc_id), 1, 32) AS chunk_id, len(list_distinct({TOKENS.format("text")})) AS n_terms FROM documents""")
def t_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.n_words(text).alias("n_words"), tx.token_estimate(text).alias("tokens"), tx.token_estimate_by_chars(text).alias("tokens_by_chars"),
        tx.query_hash(text, F.lit("ask")).alias("hash"), tx.chunk_id(F.col("lang"), F.col("doc_id")).alias("chunk_id"), F.size(F.array_distinct(tx.tokens(text))).alias("n_terms"))


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), ' | ') AS sentences FROM documents""")
def t13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.sentences(F.col("text")), " | ").alias("sentences"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS label,
'https://www.youtube.com/watch?v=' || user_id || '&t=' || s || 's' AS link FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS s FROM events)""")
def t14_time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.col("value") * 10)
    return table(spark, sf_dir, "events").select("event_id", tx.time_label(seconds).alias("label"), tx.video_link(F.col("user_id").cast("string"), seconds).alias("link"))


@query(f"""WITH terms AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in tx.KEYWORD_STOPWORDS)})) AS toks FROM documents)),
counted AS (SELECT doc_id, term, count(*) AS n, min(place) AS first FROM terms GROUP BY doc_id, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted)
SELECT d.doc_id, coalesce(string_agg(term, ', ' ORDER BY rank), '') AS keywords FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND rank <= 12 GROUP BY d.doc_id""")
def t4_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.document_keywords(table(spark, sf_dir, "documents"))


@query(f"""WITH terms AS (SELECT source, doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM (SELECT source, doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in tx.TOPIC_STOPWORDS)})) AS toks FROM documents)),
counted AS (SELECT source, term, count(*) AS n, min(struct_pack(d := doc_id, p := place)) AS first FROM terms GROUP BY source, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM counted)
SELECT source, string_agg(term, ' / ' ORDER BY rank) AS topic_label FROM ranked WHERE rank <= 5 GROUP BY source""")
def t6_topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.topic_labels(table(spark, sf_dir, "documents"), ["source"], order="doc_id")


@query(r"""SELECT doc_id, CASE WHEN y = '' THEN NULL ELSE CAST(y AS BIGINT) END AS year, regexp_matches(text, '(?m)^\s*\(?[a-d]\)?[.)]\s') AS sub_parts FROM (SELECT *, coalesce(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1)[-1], '') AS y FROM documents)""")
def t19_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.year(F.col("text")).alias("year"), tx.has_sub_parts(F.col("text")).alias("sub_parts"))


# --- chunking --------------------------------------------------------------------------------

@query("""WITH placed AS (SELECT conv_id, text, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
windows AS (SELECT DISTINCT conv_id, unnest(range(0, CAST(greatest(0, ceil((n - 6) / 4.0)) AS BIGINT) + 1)) AS window_index FROM placed)
SELECT w.conv_id, CAST(w.window_index AS BIGINT) AS window_index, min(place) AS first, max(place) AS last, count(*) AS n_segments, string_agg(coalesce(text, ''), ' ' ORDER BY place) AS text,
CAST(CASE WHEN w.window_index = 0 THEN 0 ELSE 2 END AS BIGINT) AS overlap_prev, CAST(CASE WHEN w.window_index = max(w.window_index) OVER (PARTITION BY w.conv_id) THEN 0 ELSE 2 END AS BIGINT) AS overlap_next
FROM windows w JOIN placed p ON p.conv_id = w.conv_id AND p.place BETWEEN w.window_index * 4 AND w.window_index * 4 + 5 GROUP BY w.conv_id, w.window_index""")
def c4_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sliding_windows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query()
def c5_concept_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("topics", F.array(F.lit("tion"), F.lit("eau"), F.lit("ing"), F.lit("keit")))
    return chunking.concept_blocks(turns, ["conv_id"], "turn", least=2, most=4)


@query(r"""WITH p AS (SELECT conv_id, turn, (turn + 1) || '. ' || regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '[^A-Za-z ]+', '', 'g') AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text, turn AS page_start, turn AS page_end FROM p""")
def c1_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a page that begins with a number, so it is a block of its own."""
    own = table(spark, sf_dir, "conversations").where("text is not null")
    pages = own.select("conv_id", F.col("turn").alias("page"), F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.regexp_replace(tx.cleaned(F.col("text")), "[^A-Za-z ]+", "")).alias("text"))
    return chunking.question_blocks(pages, "conv_id")


@query()
def c1_question_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.question_blocks(table(spark, sf_dir, "documents").withColumn("page", F.lit(1)), "doc_id")


@query()
def c3_qna_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.concat(F.when(F.col("role") == "user", "Question: ").otherwise("Answer: "), F.coalesce("text", F.lit(""))).alias("text"))
    blocks = chunking.question_blocks(pages, "conv_id")
    for name, value in chunking.parsed_block(F.col("text")).items():
        blocks = blocks.withColumn(name, value)
    return chunking.qna_chunks(blocks.withColumn("cluster", F.col("block") % 2), "conv_id").drop("questions", "answers")


@query(r"""WITH same AS (SELECT *, row_number() OVER (PARTITION BY source, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) ORDER BY doc_id) AS r FROM documents),
kept AS (SELECT * FROM same WHERE r = 1)
SELECT source, doc_id, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks, lag(doc_id) OVER w AS prev_chunk_id, lead(doc_id) OVER w AS next_chunk_id FROM kept WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def c18_post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chunking.post_process(table(spark, sf_dir, "documents"), "source", "doc_id", id="doc_id")
    return linked.select("source", "doc_id", "chunk_index", "total_chunks", "prev_chunk_id", "next_chunk_id")


@query("""WITH marks AS (SELECT user_id, min(epoch_us(ts)) / 1e6 AS start, strftime(ts, '%Y-%m-%d') AS title FROM events WHERE event_type = 'view' GROUP BY user_id, strftime(ts, '%Y-%m-%d')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS no FROM marks)
SELECT e.event_id, coalesce(n.title, f.title, 'Unknown') AS chapter, CAST(coalesce(n.no, CASE WHEN f.title IS NOT NULL THEN 0 END, -1) AS BIGINT) AS chapter_index
FROM events e ASOF LEFT JOIN numbered n ON e.user_id = n.user_id AND epoch_us(e.ts) / 1e6 >= n.start LEFT JOIN numbered f ON f.user_id = e.user_id AND f.no = 0""")
def c20_chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    chapters = events.where("event_type = 'view'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("title")).agg(F.min("t").alias("chapter_start"))
    return chunking.as_of_chapter(events.select("event_id", "user_id", "t"), chapters, "user_id", "t").select("event_id", "chapter", "chapter_index")


@query()
def c15_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_windows(table(spark, sf_dir, "documents"), "doc_id")


@query()
def c21_caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), "text", F.col("role").alias("chapter"))
    return chunking.caption_chunks(turns, "conv_id")


@query()
def c24_element_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = readers.html_elements(table(spark, sf_dir, "pages")).select("page_id", "at", "kind", F.col("text").alias("content"), F.lit(1).alias("page"))
    return chunking.element_chunks(elements, "page_id")


# --- cache -----------------------------------------------------------------------------------

@query(f"""WITH q AS (SELECT conv_id, turn, role, array_to_string({WORDS.format("lower(text)")}, ' ') AS norm FROM conversations)
SELECT a.conv_id, a.turn, max(b.conv_id * 1000 + b.turn) AS hit FROM q a JOIN q b ON a.role = b.role AND a.norm = b.norm GROUP BY a.conv_id, a.turn""")
def h1_cache_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(1).alias("course"), F.col("role").alias("mode"), F.col("text").alias("query"))
    entries = own.select(F.col("id").alias("entry_id"), "course", "mode", "query", F.col("id").alias("created"))
    hits = cache.exact_hits(own.withColumnRenamed("id", "query_id"), entries)
    return hits.select(F.floor(F.col("query_id") / 1000).alias("conv_id"), (F.col("query_id") % 1000).alias("turn"), F.col("entry_id").alias("hit"))


@query(f"""WITH own AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
held AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS age FROM own),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, round({COSINE}, 4) AS similarity FROM own q JOIN held c USING (label) WHERE q.vec_id % 100 = 0 AND c.age <= 200)
SELECT query_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id DESC) AS r FROM scored) WHERE r = 1 AND similarity >= 0.3""")
def h2_cache_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are what the cache retains: the newest 200 of each course and mode."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("course"), F.lit("ask").alias("mode"), F.col("vec_id").alias("created"), "embedding")
    asked = own.where("entry_id % 100 = 0").select(F.col("entry_id").alias("query_id"), "course", "mode", "embedding")
    return cache.nearest_hits(asked, cache.retention(own, F.lit(0)), 0.3)


@query("""WITH m AS (SELECT floor(epoch(max(ts))) AS now FROM events), fresh AS (SELECT event_id, user_id % 5 AS course, event_type AS mode, ts FROM events, m WHERE floor(epoch(ts)) > now - 86400 * 20)
SELECT event_id, course, mode FROM (SELECT *, row_number() OVER (PARTITION BY course, mode ORDER BY ts DESC, event_id DESC) AS r FROM fresh) WHERE r <= 200""")
def h3_cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), (F.col("user_id") % 5).alias("course"), F.col("event_type").alias("mode"), F.col("ts").cast("timestamp").alias("created"))
    now = entries.agg(F.unix_seconds(F.max("created"))).first()[0]
    return cache.retention(entries, F.lit(now), ttl=20 * 86400).select(F.col("entry_id").alias("event_id"), "course", "mode")


# --- courses ---------------------------------------------------------------------------------

def school(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers are users, parts courses (taught by the customer of their number modulo 100), orders enrolments."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "users": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 == 0, "teacher").otherwise("student").alias("role")),
        "courses": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 100).alias("teacher_id")),
        "enrolments": lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("course_id")).distinct(),
        "materials": table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("course_id"), "l_orderkey", "l_linenumber"),
        "quizzes": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quiz_id"), (F.col("o_orderkey") % 200 + 1).alias("course_id")),
        "results": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quiz_id"), F.col("l_quantity").alias("score")),
    }


SCHOOL = """users AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 'teacher' ELSE 'student' END AS role FROM customer),
courses AS (SELECT p_partkey AS course_id, p_name AS title, p_partkey % 100 AS teacher_id FROM part),
enrolments AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS course_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {SCHOOL} SELECT user_id, course_id, title FROM users JOIN courses ON teacher_id = user_id WHERE role = 'teacher'
UNION ALL SELECT user_id, course_id, title FROM users JOIN enrolments USING (user_id) JOIN courses USING (course_id) WHERE role = 'student'""")
def j1_course_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    return relational.course_list(s["courses"], s["enrolments"], s["users"]).select("user_id", "course_id", "title")


@query(f"WITH {SCHOOL} SELECT user_id, role, course_id FROM users JOIN enrolments USING (user_id)")
def j3_enrolled_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    return relational.enrolled_students(s["users"], s["enrolments"])


@query(f"""WITH {SCHOOL}, e AS (SELECT course_id, count(*) AS n FROM enrolments GROUP BY 1), m AS (SELECT l_partkey AS course_id, count(*) AS n FROM lineitem GROUP BY 1),
q AS (SELECT o_orderkey % 200 + 1 AS course_id, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT o_orderkey % 200 + 1 AS course_id, count(*) AS n, round(avg(l_quantity), 1) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT course_id, coalesce(e.n, 0) AS n_students, coalesce(m.n, 0) AS n_materials, coalesce(q.n, 0) AS n_quizzes, coalesce(r.n, 0) AS n_results, coalesce(r.s, 0) AS avg_score
FROM courses LEFT JOIN e USING (course_id) LEFT JOIN m USING (course_id) LEFT JOIN q USING (course_id) LEFT JOIN r USING (course_id)""")
def j4_course_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    return relational.course_analytics(s["courses"], s["enrolments"], s["materials"], s["quizzes"], s["results"])


@query(f"""WITH {SCHOOL}, pairs AS (SELECT c_custkey AS user_id, c_custkey % 200 + 1 AS course_id FROM customer)
SELECT user_id, course_id FROM pairs p WHERE EXISTS (SELECT 1 FROM courses c WHERE c.course_id = p.course_id AND c.teacher_id = p.user_id) OR EXISTS (SELECT 1 FROM enrolments e WHERE e.course_id = p.course_id AND e.user_id = p.user_id)""")
def j5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 200 + 1).alias("course_id"))
    return relational.members(pairs, s["courses"], s["enrolments"])


@query(f"""WITH {SCHOOL}, pairs AS (SELECT DISTINCT c_custkey AS user_id, c_custkey % 200 + 1 AS course_id FROM customer)
SELECT user_id, course_id FROM pairs EXCEPT SELECT user_id, course_id FROM enrolments""")
def j6_enrol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 200 + 1).alias("course_id"))
    return relational.enrol(s["enrolments"], pairs)


@query(f"WITH {SCHOOL}, gone AS (SELECT course_id FROM courses WHERE teacher_id < 50) SELECT user_id, course_id FROM enrolments WHERE course_id NOT IN (SELECT course_id FROM gone)")
def j8_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = school(spark, sf_dir)
    return relational.without_courses(s["courses"].where("teacher_id < 50"), s["enrolments"])[0]


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')")
def j10_history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.history_search(table(spark, sf_dir, "conversations"), "Tion", ("text",)).select("conv_id", "turn")


@query("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, string_agg('User: ' || coalesce(role, '') || chr(10) || 'Assistant: ' || substr(coalesce(text, ''), 1, 500), chr(10) ORDER BY turn) AS turns FROM last WHERE r <= 4 GROUP BY conv_id""")
def r22_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.recent_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("message"), F.col("text").alias("response")), ["conv_id"], "turn")


# --- metrics ---------------------------------------------------------------------------------

@query(f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20),
grades AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 2 ELSE 1 END AS grade FROM scored WHERE label = query_label),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS ideal, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM grades) GROUP BY query_id),
m AS (SELECT t.query_id, max(CASE WHEN grade IS NOT NULL THEN 1.0 / rank END) AS mrr, sum(CASE WHEN rank <= 10 AND grade IS NOT NULL THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN rank <= 10 AND grade IS NOT NULL THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS listed, max(CASE WHEN grade IS NOT NULL THEN 1 ELSE 0 END) AS hit, max_by(score, -rank) - max_by(score, rank) AS gap
  FROM top t LEFT JOIN grades g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id GROUP BY t.query_id)
SELECT query_id, round(CAST(coalesce(mrr, 0) AS DOUBLE), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(hits / listed, 6) AS precision, round(hits / n_rel, 6) AS recall, CAST(hit AS DOUBLE) AS hit_rate, round(gap, 6) AS score_gap FROM m JOIN ideal USING (query_id)""")
def m1_m9_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = vectors_of(spark, sf_dir)
    ranked = vectors.dense_top_k(queries, chunks, 20)
    grade = F.when(F.col("chunk_id") % 3 == 0, 2).otherwise(1)
    told = ranked.join(queries.select("query_id", F.col("label").alias("asked")), "query_id").join(chunks.select("chunk_id", "label"), "chunk_id")
    of_label = chunks.groupBy("label", grade.alias("grade")).agg(F.count("*").alias("n"))
    counts = queries.select("query_id", "label").join(of_label, "label").select("query_id", "grade", "n")
    found = metrics.graded_lists(told.withColumn("grade", F.when(F.col("asked") == F.col("label"), grade)), counts, ["query_id"], 10)
    return found.select("query_id", "hit_rate", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "precision", "recall", "score_gap")])


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c)
SELECT lang, round(sum(-p * log2(p)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 6) AS diversity FROM p GROUP BY lang""")
def m8_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entropy(table(spark, sf_dir, "documents"), ["lang"], "source").withColumn("diversity", F.round("diversity", 6))


@query(f"""WITH s AS (SELECT lang, greatest(1, CAST(floor(len({WORDS.format("text")}) * CAST(1.3 AS DOUBLE)) AS BIGINT)) AS size FROM documents)
SELECT lang, count(*) AS n, round(avg(size), 6) AS mean, round(coalesce(stddev_samp(size), 0), 6) AS sd, min(size) AS min, max(size) AS max, round(quantile_cont(size, 0.05), 6) AS p5, round(quantile_cont(size, 0.95), 6) AS p95,
round(avg(CASE WHEN size < 20 THEN 1.0 ELSE 0.0 END), 6) AS under_rate, round(avg(CASE WHEN size > 800 THEN 1.0 ELSE 0.0 END), 6) AS over_rate FROM s GROUP BY lang""")
def m13_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.size_stats(table(spark, sf_dir, "documents"), ["lang"])
    return found.select("lang", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p5", "p95", "under_rate", "over_rate")])


@query("""SELECT source, field, round(rate, 6) AS rate, rate < 0.9 AS critical FROM (
SELECT source, 'lang' AS field, avg(CASE WHEN lang IS NOT NULL AND lang <> '' THEN 1.0 ELSE 0.0 END) AS rate FROM documents GROUP BY source UNION ALL
SELECT source, 'text', avg(CASE WHEN text IS NOT NULL AND text <> '' THEN 1.0 ELSE 0.0 END) FROM documents GROUP BY source UNION ALL
SELECT source, 'n_chars', avg(CASE WHEN n_chars IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM documents GROUP BY source)""")
def m14_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.completeness(table(spark, sf_dir, "documents"), ["lang", "text", "n_chars"], ["source"])
    return found.withColumn("rate", F.round("rate", 6))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6 + value * 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, round(coalesce(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap < -1 THEN 1.0 ELSE 0.0 END), 0), 6) AS overlap_rate FROM g GROUP BY user_id""")
def m20_overlap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    placed = own.withColumn("end", F.col("start") + F.col("value") * 100).withColumn("order", F.struct("ts", "event_id"))
    return metrics.overlap_rate(placed, ["user_id"], "order", "start", "end").withColumn("overlap_rate", F.round("overlap_rate", 6))


@query("""SELECT event_type AS stage, CAST(25 AS DOUBLE) AS slo, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(CASE WHEN value <= 25 THEN 1.0 ELSE 0.0 END), 6) AS slo_rate, quantile_cont(value, 0.95) <= 25 AS passed FROM events GROUP BY event_type""")
def m32_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    levels = {r[0]: 25 for r in events.select("event_type").distinct().collect()}
    found = metrics.latency(events, "event_type", "value", levels)
    return found.select("stage", "slo", "n", "min", "max", "passed", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p50", "p95", "p99", "slo_rate")])


@query("""WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS own FROM a),
t AS (SELECT DISTINCT source, lang, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 WHEN 'xx' THEN 0.2 END AS share FROM (SELECT DISTINCT source FROM documents), (VALUES ('en'), ('de'), ('xx')) v(lang))
SELECT source, round(least(sum(abs(coalesce(own, 0) - coalesce(share, 0))), 1), 6) AS error FROM s FULL JOIN t USING (source, lang) GROUP BY source""")
def m31_distribution_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shares = F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(v).alias("share")) for k, v in (("en", 0.5), ("de", 0.3), ("xx", 0.2))])
    target = docs.select("source").distinct().select("source", F.explode(shares).alias("t")).select("source", "t.*")
    return metrics.distribution_error(docs, target, ["source"], "lang").withColumn("error", F.round("error", 6))


@query(r"""WITH t AS (SELECT DISTINCT text AS syllabus, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w FROM benchmark),
o AS (SELECT DISTINCT text AS other FROM benchmark), ow AS (SELECT other, list_distinct(list_filter(regexp_split_to_array(lower(other), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w FROM o)
SELECT t.syllabus AS text, round(max(len(list_intersect(t.w, ow.w)) / len(t.w)), 6) AS best, max(len(list_intersect(t.w, ow.w)) / len(t.w)) >= 0.5 AS covered FROM t, ow GROUP BY t.syllabus""")
def m28_topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark")
    return metrics.topic_coverage(own, own, "text").withColumn("best", F.round("best", 6))


# --- budgets ---------------------------------------------------------------------------------

def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("mode"), F.when(F.col("user_id") % 10 == 0, "teacher").otherwise("student").alias("role"), "ts", F.floor(F.col("value") * 1000).alias("tokens"))


@query("""WITH e AS (SELECT event_id, user_id, event_type AS mode, epoch_us(ts) AS us, CAST(floor(value * 1000) AS BIGINT) AS tokens FROM events)
SELECT event_id, CAST(coalesce(sum(CASE WHEN tokens > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY user_id, mode ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_window FROM e""")
def w1_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.sliding_usage(spending(spark, sf_dir), 36_000).select("event_id", "used_window")


@query("""SELECT event_id, CAST(coalesce(sum(CASE WHEN t > 0 THEN t ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_day
FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS t FROM events)""")
def w3_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.daily_usage(spending(spark, sf_dir)).select("event_id", "used_day")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id, event_type AS mode, ts, CAST(floor(value * 1000) AS BIGINT) AS t FROM events),
b AS (SELECT user_id, mode, sum(CASE WHEN epoch_us(ts) >= epoch_us(now) - 60000000 THEN t ELSE 0 END) AS last_minute, sum(CASE WHEN CAST(ts AS DATE) = CAST(now AS DATE) THEN t ELSE 0 END) AS d FROM e, m GROUP BY user_id, mode)
SELECT user_id, mode, CAST(last_minute AS BIGINT) AS last_minute, CAST(sum(d) OVER (PARTITION BY user_id) AS BIGINT) AS day FROM b""")
def w8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spending(spark, sf_dir)
    now = own.agg(F.max("ts").cast("timestamp")).first()[0]
    return rate_limit.usage(own, F.lit(now))


# --- store -----------------------------------------------------------------------------------

@query("""SELECT 'n' || label AS namespace, count(*) AS n, max(len(embedding)) AS dimension FROM embeddings GROUP BY label UNION ALL SELECT NULL, count(*), max(len(embedding)) FROM embeddings""")
def k5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.stats(table(spark, sf_dir, "embeddings").withColumn("namespace", F.concat(F.lit("n"), F.col("label").cast("string"))))


@query("""WITH v AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id FROM v WHERE r = 1""")
def k3_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    return writers.latest(None, events, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("""SELECT DISTINCT source, 'course-' || source || '-' || substr(sha256(source), 1, 8) AS name FROM documents""")
def k2_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", tx.index_name(F.col("source")).alias("name")).distinct()


# --- shown chunks and recognised pages ---------------------------------------------------------

@query("""SELECT doc_id, source || ' · pp. ' || (doc_id % 9 + 1) || ' · § ' || lang AS citation, trim(concat_ws(' ', nullif(text, ''), nullif(lang, ''))) AS search_text, substr(coalesce(text, ''), 1, 320) AS preview FROM documents""")
def t28_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("source"), F.col("source").alias("source_file"), F.col("text").alias("raw_text"), (F.col("doc_id") % 9 + 1).cast("string").alias("page_range"), F.col("lang").alias("section_title"))
    shown = display.retrieved(docs)
    return shown.select("doc_id", "citation", F.trim(display.search_text()).alias("search_text"), F.substring("display_text", 1, 320).alias("preview"))


@query()
def t22_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", ocr.looks_like_code(text).alias("code"), ocr.code_language(text).alias("language"))


@query("""WITH t AS (SELECT event_id, CASE WHEN b < 70 AND c > 40 THEN 'low_light' WHEN b > 200 AND c < 35 AND blur > 400 THEN 'clean_scan' WHEN noise = 'high' AND c < 50 THEN 'noisy_print' WHEN watermark THEN 'watermarked'
WHEN b < 130 AND blur < 80 THEN 'photo' WHEN c < 30 AND b > 90 AND b < 180 THEN 'newspaper' ELSE 'mixed' END AS image_type, c, blur, noise FROM (
SELECT event_id, event_id % 256 AS b, user_id % 70 AS c, event_id % 600 AS blur, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS noise, event_id % 17 = 0 AS watermark FROM events))
SELECT event_id, image_type, CASE WHEN image_type = 'newspaper' THEN 'sauvola' WHEN image_type = 'clean_scan' AND c > 60 THEN 'otsu' WHEN image_type IN ('photo', 'low_light') THEN 'adaptive_gauss' END AS binariser,
CASE WHEN noise = 'high' OR blur < 50 THEN 11 WHEN image_type IN ('clean_scan', 'newspaper') THEN 4 ELSE 3 END AS psm FROM t""")
def i1_page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("brightness"), (F.col("user_id") % 70).alias("contrast"), (F.col("event_id") % 600).alias("blur"), F.when(F.col("event_type") == "error", "high").otherwise("low").alias("noise"), (F.col("event_id") % 17 == 0).alias("watermark"))
    return ocr.page_decisions(seen).select("event_id", "image_type", "binariser", "psm")


WORD_BOXES = "SELECT user_id, event_id // 10 AS block_num, event_id AS word_num, props AS text, value AS conf, event_id % 50 AS x, event_id % 31 AS y, 5 AS w, 7 AS h FROM events"
BLOCKS = f"""kept AS (SELECT user_id, block_num, string_agg(text, ' ' ORDER BY word_num) AS text, avg(conf) AS confidence, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({WORD_BOXES}) WHERE conf >= 0 AND trim(text) <> '' GROUP BY ALL HAVING avg(conf) >= 45),
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY y, x, block_num) - 1 AS reading_order FROM kept WHERE length(text) >= 3)"""


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", F.floor(event / 10).alias("block_num"), event.alias("word_num"), F.col("props").alias("text"), F.col("value").alias("conf"), (event % 50).alias("x"), (event % 31).alias("y"), F.lit(5).alias("w"), F.lit(7).alias("h"))


@query(f"WITH {BLOCKS} SELECT user_id, block_num, text, round(confidence, 6) AS confidence, x, y, w, h, reading_order FROM ordered")
def c31_ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.blocks(word_boxes(spark, sf_dir), ["user_id"]).withColumn("confidence", F.round("confidence", 6))


@query("""WITH v AS (SELECT item_id, mode, source, CASE WHEN mode = 'quiz' AND source = 'qna' AND item_id % 2 = 0 THEN 2.2 WHEN mode = 'summarize' AND source = 'documents' AND item_id % 3 = 0 THEN 1.9 WHEN mode = 'quiz' AND source = 'youtube' AND item_id % 5 = 0 THEN 1.0
ELSE CASE mode || ' ' || source WHEN 'ask qna' THEN 2.0 WHEN 'quiz qna' THEN 2.8 WHEN 'quiz documents' THEN 1.8 WHEN 'summarize documents' THEN 2.2 WHEN 'ask youtube' THEN 1.0 WHEN 'quiz youtube' THEN 0.8 ELSE 1.0 END END AS weight
FROM benchmark, (VALUES ('ask'), ('quiz'), ('summarize')) m(mode), (VALUES ('qna'), ('documents'), ('youtube')) s(source)),
a AS (SELECT item_id, avg(weight) FILTER (mode = 'quiz' AND source = 'qna') - avg(weight) FILTER (mode = 'ask' AND source = 'qna') AS d1, avg(weight) FILTER (mode = 'summarize' AND source = 'documents') - avg(weight) FILTER (mode = 'quiz' AND source = 'documents') AS d2,
avg(weight) FILTER (mode = 'ask' AND source = 'youtube') - avg(weight) FILTER (mode = 'quiz' AND source = 'youtube') AS d3 FROM v GROUP BY item_id)
SELECT item_id, round(((d1 >= 0.3)::INT + (d2 >= 0.2)::INT + (d3 >= 0.1)::INT) / 3.0, 6) AS adaptation FROM a""")
def m29_mode_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item a planner of its own, some of which don't tell modes apart."""
    item, mode, source = F.col("item_id"), F.col("mode"), F.col("source")
    own = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, ("ask", "quiz", "summarize")))).alias("mode")).withColumn("source", F.explode(F.array(*map(F.lit, ("qna", "documents", "youtube")))))
    weight = F.lit(1.0)
    for m, weights in ranking.MODE_WEIGHTS.items():
        weight = F.when(mode == m, ranking.lookup(weights, source)).otherwise(weight)
    weight = F.when((mode == "quiz") & (source == "qna") & (item % 2 == 0), 2.2).when((mode == "summarize") & (source == "documents") & (item % 3 == 0), 1.9).when((mode == "quiz") & (source == "youtube") & (item % 5 == 0), 1.0).otherwise(weight)
    return metrics.mode_adaptation(metrics.source_weights(own.withColumn("weight", weight), ["item_id"]), ["item_id"])


# --- further chunkers ------------------------------------------------------------------------

@query(f"""WITH s AS (SELECT conv_id, turn // 3 AS chunk, turn, text, len({WORDS.format("text")}) AS n FROM conversations)
SELECT conv_id, chunk, CAST(sum(n) AS BIGINT) AS word_count, CAST(min(turn) AS DOUBLE) AS start_seconds, CAST(max(turn) + 1 AS DOUBLE) AS end_seconds, round(avg(0.5 + (turn % 4) / 10.0), 4) AS avg_confidence,
CASE WHEN contains(lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)), 'tion') THEN CASE WHEN contains(lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)), 'eau') THEN 'eau,tion' ELSE 'tion' END
WHEN contains(lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)), 'eau') THEN 'eau' ELSE 'eau,tion' END AS concepts FROM s GROUP BY conv_id, chunk""")
def c8_audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.floor(F.col("turn") / 3).alias("chunk"), "text", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"),
        (0.5 + (F.col("turn") % 4) / 10).alias("confidence"), F.lit(False).alias("is_unclear"), F.array(F.lit("tion"), F.lit("eau")).alias("topics"))
    found = chunking.audio_chunks(turns, ["conv_id"], "chunk", "turn")
    return found.select("conv_id", "chunk", F.col("word_count").cast("bigint").alias("word_count"), "start_seconds", "end_seconds", "avg_confidence", F.array_join(F.array_sort("concepts"), ",").alias("concepts"))


@query()
def c22_timed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.timed_captions(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), "text"), "conv_id")


MARKED = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '$$' WHEN 3 THEN '|' WHEN 4 THEN '[diagram: ' ELSE '' END || coalesce(text, '') AS text FROM documents"


@query(rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS bs FROM ({MARKED})),
r AS (SELECT doc_id, unnest(range(len(bs))) AS place, unnest(bs) AS b FROM b)
SELECT doc_id, place, CASE WHEN regexp_matches(b, '^##{{1,2}}\s') THEN 'Heading' WHEN regexp_matches(b, '^#\s') THEN 'Title' WHEN regexp_matches(b, '^\$\$|^\\\[') THEN 'Equation' WHEN starts_with(b, '|') THEN 'Table' WHEN regexp_matches(lower(b), '^\[diagram:') THEN 'Diagram' ELSE 'Paragraph' END AS kind,
sha256(CASE WHEN regexp_matches(b, '^#{{1,3}}\s') THEN trim(regexp_replace(b, '^#+\s*', '')) ELSE b END) AS content FROM r""")
def c28_markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document begins with a mark of one of six kinds."""
    marks = F.array(*map(F.lit, ("# ", "## ", "$$", "|", "[diagram: ", "")))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.get(marks, F.col("doc_id") % 6), F.coalesce("text", F.lit(""))))
    return chunking.markdown_elements(docs, ["doc_id"]).select("doc_id", F.col("at").alias("place"), "kind", F.sha2("content", 256).alias("content"))


@query("""SELECT event_id, CASE WHEN value / 100 < 0.5 AND event_id % 2 = 0 THEN 'pro' ELSE 'flash' END AS model, CASE WHEN value / 100 < 0.5 AND event_id % 2 = 0 THEN 0.9 ELSE value / 100 END AS confidence FROM events""")
def c29_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheap = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"), (F.col("value") / 100).alias("confidence"))
    better = ocr.to_escalate(cheap, 0.5).where("event_id % 2 = 0").select("event_id", F.lit("better").alias("text"), F.lit(0.9).alias("confidence"))
    return ocr.escalated(cheap, better, ["event_id"], 0.5).select("event_id", "model", "confidence")


@query("""SELECT lang, count(*) AS n, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long_rate, round(avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0.0 END), 6) AS loud_rate FROM documents GROUP BY lang""")
def m15_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.rates(table(spark, sf_dir, "documents"), ["lang"], {"long_rate": F.col("n_chars") > 1000, "loud_rate": F.contains("text", F.lit("!"))})
    return found.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("long_rate", "loud_rate")])


@query(f"""SELECT doc_id, CASE WHEN len({WORDS.format("lower(text)")}) = 0 THEN 0 ELSE round(least(len(list_distinct({WORDS.format("lower(text)")})) / len({WORDS.format("lower(text)")}) + 0.1, 1), 6) END AS richness FROM documents""")
def m35_text_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(metrics.text_richness(F.col("text")), 6).alias("richness"))


def load() -> None:
    """The other catalogues register as they are imported."""
    from ragloom import catalog_tables, catalog_texts  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
