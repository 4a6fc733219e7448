"""Evaluation metrics as grouped DataFrame jobs: retrieval, chunk sizes and completeness, answers, coverage, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as tx

#: Service levels in milliseconds by stage.
SLOS = {
    "planner_ms": 4000, "embedding_ms": 1500, "dense_retrieve_ms": 800, "bm25_ms": 200, "mmr_ms": 100, "rrf_ms": 100, "total_ms": 8000,
    "qna_chunk_ms": 3000, "audio_chunk_ms": 1000, "document_chunk_ms": 5000, "image_ocr_ms": 15000, "handwritten_ocr_ms": 10000, "youtube_ingest_ms": 5000,
}
#: Words that an answer of each length has, and the words a chunk of each source should have.
ANSWER_WORDS = {"short": (40, 350), "medium": (200, 900), "long": (500, 3000)}
CHUNK_WORDS = {"qna": (20, 800), "audio": (30, 600), "documents": (40, 900), "image": (25, 500), "handwritten": (20, 700), "youtube": (60, 550)}
#: Marks of the answer formats.
FORMATS = {
    "structured_explanation": [r"##\s+", r"\*\*", r"\n\n"],
    "definition_then_example": [r"(?:defined as|definition|means that)", r"(?:for example|e\.g\.|instance)"],
    "comparison_table": [r"\|.*\|", r"vs\.?\s", r"compared to"],
    "worked_solution": [r"(?:step \d|given:|find:|solution:)", r"=\s*\d"],
    "quiz_questions": [r"^\d+[.)]\s", r"(?:answer|correct answer|explanation):"],
    "topic_summary": [r"##\s+", r"overview|summary|key points"],
    "bullet_summary": [r"^[\-\*]\s", r"•\s"],
    "conceptual_prose": [],
}


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def entropy(df: DataFrame, keys: list[str], value: str, out: str = "diversity") -> DataFrame:
    """Shannon entropy of a group's values over the logarithm of how many differ; 0 for one value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return total.groupBy(*keys).agg((F.sum(-F.col("p") * F.log2("p")) / F.when(F.count("*") > 1, F.log2(F.count("*"))).otherwise(1.0)).alias(out))


def ideals(counts: DataFrame, keys: list[str], k: int, linear: bool = False) -> DataFrame:
    """keys, ideal and n_relevant: the gain of the best list of ``k``, from how many items have each grade (keys, grade, n)."""
    relevant = counts.where("grade > 0")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.least(F.col("before") + F.col("n"), F.lit(k)).cast("int")
    places = F.when(upto > F.col("before"), F.sequence((F.col("before") + 1).cast("int"), upto)).otherwise(F.array().cast("array<int>"))
    share = F.aggregate(places, F.lit(0.0), lambda a, p: a + gain(F.col("grade"), linear) / F.log2(p + 1))
    return relevant.withColumn("before", before).groupBy(*keys).agg(F.sum(share).alias("ideal"), F.sum("n").alias("n_relevant"))


def gain(grade: Column, linear: bool) -> Column:
    return grade.cast("double") if linear else F.pow(F.lit(2.0), grade) - 1


def retrieval(ranked: DataFrame, grades: DataFrame, keys: list[str], k: int, item: str = "chunk_id", linear: bool = False) -> DataFrame:
    """mrr, ndcg, precision, recall, hit and score_gap of each list.

    ``ranked``: keys, item, rank (from 1), score.  ``grades``: keys, item, grade; what is absent has grade
    0.  The gain is 2^grade - 1, or the grade itself if ``linear``; the ideal list sorts all grades.
    """
    relevant = grades.where("grade > 0").select(*keys, item, "grade")
    return graded_lists(ranked.join(relevant, [*keys, item], "left"), relevant.groupBy(*keys, "grade").agg(F.count("*").alias("n")), keys, k, linear)


def graded_lists(graded: DataFrame, counts: DataFrame, keys: list[str], k: int, linear: bool = False) -> DataFrame:
    """retrieval() of lists whose rows know their ``grade`` (null: none), with the counts of ideals(): no list of all relevant items is made."""
    hit, near = F.col("grade") > 0, F.col("rank") <= k
    found = graded.withColumn("grade", F.when(hit, F.col("grade"))).groupBy(*keys).agg(
        F.max(F.when(hit, 1 / F.col("rank"))).alias("mrr"), F.sum(F.when(hit & near, gain(F.col("grade"), linear) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.coalesce(hit & near, F.lit(False)).cast("int")).alias("hits"), F.sum(near.cast("int")).alias("listed"), F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("hit"), F.count("*").alias("n"),
        (F.max_by("score", -F.col("rank")) - F.max_by("score", "rank")).alias("gap"))
    m = found.join(ideals(counts, keys, k, linear), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.select(*keys, F.coalesce("mrr", F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"), ratio(F.col("hits"), F.col("listed")).alias("precision"),
                    ratio(F.col("hits"), zero("n_relevant")).alias("recall"), F.col("hit").cast("double").alias("hit_rate"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("gap")).alias("score_gap"))


def source_coverage(df: DataFrame, found: str, expected: str, out: str = "source_coverage") -> DataFrame:
    """Of arrays: how much of the expected sources was found; 1 if none was expected."""
    wanted = F.array_distinct(expected)
    return df.withColumn(out, ratio(F.size(F.array_intersect(F.col(found), wanted)), F.size(wanted), 1.0))


def size_stats(df: DataFrame, keys: list[str], text: str = "text", least: int = 20, most: int = 800) -> DataFrame:
    """Token estimates of texts: n, mean, sd (0 for one), min, max, p5, p95, and the rates under and over bounds."""
    sized = df.select(*keys, tx.token_estimate(F.col(text)).alias("size"))
    size = F.col("size")
    return sized.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(size).alias("mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("sd"), F.min(size).alias("min"), F.max(size).alias("max"),
        F.percentile(size, F.lit(0.05)).alias("p5"), F.percentile(size, F.lit(0.95)).alias("p95"), F.avg((size < least).cast("double")).alias("under_rate"), F.avg((size > most).cast("double")).alias("over_rate"))


def completeness(df: DataFrame, fields: list[str], keys: list[str] | None = None, critical: float = 0.9) -> DataFrame:
    """keys, field, rate and whether it is under ``critical``: how often a field says anything."""
    keys, kinds = keys or [], dict(df.dtypes)
    wide = df.groupBy(*keys).agg(*[F.avg(tx.non_empty(F.col(f), kinds[f]).cast("double")).alias(f) for f in fields])
    return wide.unpivot(keys, fields, "field", "rate").withColumn("critical", F.col("rate") < critical)


def overlap_rate(df: DataFrame, keys: list[str], order: str, start: str, end: str, slack: float = 1.0, out: str = "overlap_rate") -> DataFrame:
    """Of consecutive chunks the share that begins more than ``slack`` seconds before the one before ends."""
    gap = df.withColumn("gap", F.col(start) - F.lag(end).over(Window.partitionBy(*keys).orderBy(order)))
    return gap.groupBy(*keys).agg(F.coalesce(F.avg((F.col("gap") < -slack).cast("double")), F.lit(0.0)).alias(out))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda c: c.cast("int"))


def answers(df: DataFrame) -> DataFrame:
    """Append the checks of an answer against its context.

    Needs answer, context, n_chunks, keywords (array), length ("short", "medium", "long") and format.
    """
    answer = F.coalesce(F.col("answer"), F.lit(""))
    cited = F.array_distinct(F.filter(citations(answer), lambda c: (c >= 1) & (c <= F.col("n_chunks"))))
    long_sentences = F.filter(tx.sentences(answer), lambda s: tx.n_words(s) >= 4)
    n = F.size(long_sentences)
    known = tx.answer_tokens(F.col("context"))
    groundless = F.filter(long_sentences, lambda s: F.size(F.array_intersect(tx.answer_tokens(s), known)) == 0)
    words = tx.n_words(answer)
    bounds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in ANSWER_WORDS.items() for x in pair])
    own = F.element_at(bounds, F.col("length"))
    wanted = F.array_distinct("keywords")
    matched = F.filter(wanted, lambda k: F.lower(answer).contains(F.lower(k)))
    aligned = F.lit(1.0)
    for name, patterns in FORMATS.items():
        if patterns:
            share = sum((answer.rlike(f"(?im){p}").cast("int") for p in patterns), F.lit(0)) / len(patterns)
            aligned = F.when(F.col("format") == name, share).otherwise(aligned)
    return df.select(
        "*", ratio(F.size(cited), F.col("n_chunks")).alias("context_utilisation"), ratio(F.size(F.filter(long_sentences, lambda s: s.rlike(r"\[\d+\]"))), n).alias("citation_coverage"),
        F.coalesce((words >= own[0]) & (words <= own[1]), F.lit(True)).alias("length_ok"), ratio(F.size(matched), F.size(wanted), 1.0).alias("keyword_recall"),
        ratio(F.size(groundless), n).alias("hallucination"), aligned.alias("plan_alignment"))


def attribution_balance(df: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Entropy of an answer's citations over how many differ; 0 with fewer than two."""
    cited = df.select(*keys, F.explode_outer(citations(F.col(answer))).alias("cite"))
    found = entropy(cited.where("cite is not null"), keys, "cite", "balance")
    return df.select(*keys).distinct().join(found, keys, "left").withColumn("balance", F.coalesce("balance", F.lit(0.0)))


def topic_coverage(topics: DataFrame, retrieved: DataFrame, topic: str = "topic", least: float = 0.5) -> DataFrame:
    """Of each topic of a (bounded) syllabus the best share of its words in one retrieved topic, and whether it is covered.

    Joined by shared words, not by all pairs.
    """
    own = topics.select(F.col(topic).alias("syllabus"), F.array_distinct(tx.words(F.lower(F.col(topic)))).alias("w"))
    seen = retrieved.select(F.col(topic).alias("other")).distinct().select("other", F.explode(F.array_distinct(tx.words(F.lower(F.col("other"))))).alias("word"))
    shares = own.select("syllabus", F.size("w").alias("n"), F.explode("w").alias("word")).join(seen, "word").groupBy("syllabus", "n", "other").agg(F.count("*").alias("common"))
    best = shares.groupBy("syllabus").agg(F.max(F.col("common") / F.col("n")).alias("best"))
    found = own.select("syllabus").distinct().join(best, "syllabus", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return found.select(F.col("syllabus").alias(topic), "best", (F.col("best") >= least).alias("covered"))


def planner_selection(df: DataFrame, planned: str = "planned", expected: str = "expected", excluded: str = "excluded") -> DataFrame:
    """Append precision and recall of the planned sources, less the share that was to be excluded, not under 0, to four places."""
    plan, want = F.array_distinct(planned), F.array_distinct(expected)
    good, bad = F.size(F.array_intersect(plan, want)), F.size(F.array_intersect(plan, F.col(excluded)))
    penalty = ratio(bad, F.size(plan))
    return df.select("*", F.round(F.greatest(ratio(good, F.size(plan)) - penalty, F.lit(0.0)), 4).alias("precision"), F.round(F.when(F.size(plan) == 0, 0.0).otherwise(ratio(good, F.size(want), 1.0)), 4).alias("recall"))


def distribution_error(actual: DataFrame, target: DataFrame, keys: list[str], level: str = "difficulty") -> DataFrame:
    """Sum of the absolute differences of two distributions over the union of levels, 1 at most; 1 where nothing is known.

    ``actual``: keys, level.  ``target``: keys, level, share.
    """
    counts = actual.groupBy(*keys, level).agg(F.count("*").alias("n"))
    shares = counts.select(*keys, level, (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("own"))
    both = shares.join(target, [*keys, level], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    found = both.groupBy(*keys).agg(F.least(F.sum(F.abs(zero("own") - zero("share"))), F.lit(1.0)).alias("error"), F.count("own").alias("n"))
    return found.select(*keys, F.when(F.col("n") == 0, 1.0).otherwise(F.col("error")).alias("error"))


def latency(df: DataFrame, stage: str = "stage", ms: str = "ms", slos: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sd, min, max, p50, p95, p99, the share within the stage's service level, and whether p95 is."""
    table = {**SLOS, **(slos or {})}
    slo = F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), F.col(stage))
    own = df.select(F.col(stage).alias("stage"), F.col(ms).cast("double").alias("ms"), slo.alias("slo"))
    p = lambda q: F.percentile("ms", F.lit(q))
    found = own.groupBy("stage", "slo").agg(
        F.count("*").alias("n"), F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sd"), F.min("ms").alias("min"), F.max("ms").alias("max"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg((F.col("ms") <= F.col("slo")).cast("double")).alias("slo_rate"))
    return found.withColumn("passed", F.col("p95") <= F.col("slo"))


def health(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """One row: every gate over the averages of ``metrics``, and ``healthy`` if all hold."""
    gates = {f"{c}_ok": F.avg(c) >= v for c, v in least.items()} | {f"{c}_ok": F.avg(c) <= v for c, v in most.items()}
    row = metrics.agg(*[F.coalesce(test, F.lit(False)).alias(name) for name, test in gates.items()])
    healthy = F.lit(True)
    for name in gates:
        healthy = healthy & F.col(name)
    return row.withColumn("healthy", healthy)


def chunk_report(df: DataFrame, source: str) -> DataFrame:
    """Size statistics of a source's chunks with the source's own bounds, in one row."""
    least, most = CHUNK_WORDS[source]
    return size_stats(df.withColumn("source", F.lit(source)), ["source"], "text", least, most)


def source_weights(plans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The mean weight of each mode and source."""
    return plans.groupBy(*(keys or []), "mode", "source").agg(F.avg("weight").alias("weight"))


def mode_adaptation(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of three expected differences between modes' source weights the share that holds: one row, or one for each of ``keys``."""
    w = lambda mode, source: F.coalesce(F.max(F.when((F.col("mode") == mode) & (F.col("source") == source), F.col("weight"))), F.lit(0.0))
    far = lambda a, b, least: F.round(a - b, 9) >= least
    checks = [far(w("quiz", "qna"), w("ask", "qna"), 0.3), far(w("summarize", "documents"), w("quiz", "documents"), 0.2), far(w("ask", "youtube"), w("quiz", "youtube"), 0.1)]
    return weights.groupBy(*(keys or [])).agg(F.round(sum((c.cast("int") for c in checks), F.lit(0)) / len(checks), 6).alias("adaptation"))


def rates(df: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """The share of rows for which each test holds; null counts as no."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(t, F.lit(False)).cast("double")).alias(name) for name, t in tests.items()])


def source_rates(df: DataFrame, source: str, keys: list[str] | None = None) -> DataFrame:
    """The rates that a source's chunks are judged by."""
    c = F.col
    tests = {
        "qna": lambda: {"qa_rate": c("chunk_type").isin("single_qa", "multi_qa"), "answers_rate": F.size("answers") > 0, "year_rate": c("year_hint") > 0, "marks_rate": c("marks_hint") > 0},
        "audio": lambda: {"low_confidence_rate": c("avg_confidence") < 0.7, "concept_rate": c("strategy") == "concept_block", "unclear_rate": c("has_unclear_segments")},
        "documents": lambda: {"table_rate": c("has_table"), "image_rate": c("has_image"), "list_rate": c("has_list")},
        "image": lambda: {"low_confidence_rate": c("ocr_confidence") < 80, "code_rate": c("has_code"), "formula_rate": c("has_formula"), "linked_rate": c("prev_chunk_id").isNotNull() | c("next_chunk_id").isNotNull()},
        "handwritten": lambda: {"flash_rate": F.lower("model_used").contains("flash"), "pro_rate": F.lower("model_used").contains("pro"), "good_ink_rate": c("ink_quality") == "good", "equation_rate": c("has_equations")},
        "youtube": lambda: {"chapter_rate": (c("chapter_title") != "") & (c("chapter_title") != "Unknown"), "deep_link_rate": c("deep_link") != "", "manual_rate": ~c("is_generated_transcript")},
    }
    return rates(df, keys or [], tests[source]())


def temporal_coverage(df: DataFrame, keys: list[str], end: str, duration: str) -> DataFrame:
    """How far the last chunk reaches into the recording, 1 at most."""
    return df.groupBy(*keys).agg(F.least(F.coalesce(F.try_divide(F.max(end), F.max(duration)), F.lit(0.0)), F.lit(1.0)).alias("coverage"))


def text_richness(text: Column) -> Column:
    """Distinct words over words, and 0.1 more, 1 at most."""
    words = tx.words(F.lower(text))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.size(F.array_distinct(words)) / F.size(words) + 0.1, F.lit(1.0)))


def dedup_rate(df: DataFrame, kept: str = "n_kept", asked: str = "n_asked", out: str = "dedup_rate") -> DataFrame:
    """Append the share of sub-queries that were kept; 0 without any."""
    return df.withColumn(out, ratio(F.col(kept), F.col(asked)))


def planner_ratio(planner_ms: Column, total_ms: Column) -> Column:
    """How much of a query's time its planning took, 1 at most; 0 without time."""
    return F.coalesce(F.least(F.try_divide(planner_ms, total_ms), F.lit(1.0)), F.lit(0.0))


#: The fields that a source's chunks should fill, and the field whose values are counted.
SOURCE_FIELDS = {
    "qna": (("text", "chunk_type", "questions"), "chunk_type"), "audio": (("text", "lecture_title", "strategy"), "strategy"), "documents": (("text", "section_title", "source_file"), "element_type"),
    "image": (("text", "image_type", "source_file"), "image_type"), "handwritten": (("text", "topic", "source_file"), "content_type"), "youtube": (("text", "video_title", "chapter_title"), "chapter_title"),
}


def source_evaluation(chunks: DataFrame, source: str) -> DataFrame:
    """A source's chunks as (metric, value): sizes against the source's bounds, completeness of its fields, its rates, and how its kinds are shared out.

    A column that the chunks lack counts as null.
    """
    fields, kind = SOURCE_FIELDS[source]
    needed = {"text": "string", **{f: "string" for f in (*fields, kind)}, **RATE_FIELDS[source]}
    own = chunks.withColumns({c: F.lit(None).cast(t) for c, t in needed.items() if c not in chunks.columns})
    least, most = CHUNK_WORDS[source]
    sizes = size_stats(own, [], "text", least, most)
    long = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    parts = [long(sizes, sizes.columns), completeness(own, list(fields)).select(F.concat(F.lit("filled:"), "field").alias("metric"), F.col("rate").alias("value"))]
    rated = source_rates(own, source)
    parts.append(long(rated, [c for c in rated.columns if c != "n"]))
    shares = own.groupBy(kind).agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("total"))
    parts.append(shares.crossJoin(F.broadcast(total)).select(F.concat(F.lit("share:"), F.coalesce(kind, F.lit("none"))).alias("metric"), (F.col("n") / F.col("total")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The columns that source_rates() reads.
RATE_FIELDS = {
    "qna": {"chunk_type": "string", "answers": "array<string>", "questions": "array<string>", "year_hint": "int", "marks_hint": "int"}, "audio": {"avg_confidence": "double", "strategy": "string", "has_unclear_segments": "boolean"},
    "documents": {"has_table": "boolean", "has_image": "boolean", "has_list": "boolean"},
    "image": {"ocr_confidence": "double", "has_code": "boolean", "has_formula": "boolean", "prev_chunk_id": "string", "next_chunk_id": "string"},
    "handwritten": {"model_used": "string", "ink_quality": "string", "has_equations": "boolean"}, "youtube": {"chapter_title": "string", "deep_link": "string", "is_generated_transcript": "boolean"},
}
