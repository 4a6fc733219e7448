"""Live evaluation in one table, and percentiles from mergeable sketches.

live_report() reads each of its inputs once: lists, answers and chunks of all scenarios and sources are summed in one
grouping each, with GROUPING SETS for the totals, instead of a scan for every metric and source.  The gates of the whole
run are observed while the report is written (DataFrame.observe), without another pass.

daily_sketches() keeps a KLL sketch of a few kilobytes for each group and day; percentiles() merges days.  A quantile's
rank is off by at most RANK_ERROR of the values, however many there are; the exact forms (metrics.size_stats,
metrics.latency) hold every distinct value of a group at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ragloom.functions import text as tx
from ragloom.operators import metrics
from ragloom.operators.ranking import SOURCES

#: Accuracy parameter of the sketches, and the error of ranks, in parts of all values, that it keeps at 99 percent confidence.
SKETCH_K, RANK_ERROR = 400, 0.0085

# The fields that a live chunk of each source has to fill, the words that it may have, and the gates of a run.
LIVE_FIELDS = {
    "qna": ("chunk_type", "topic", "source_file"), "image": ("source_file", "course_id"), "audio": ("strategy", "lecture_title"), "youtube": ("video_title", "deep_link"),
    "documents": ("source_file", "section_title"), "handwritten": ("source_file", "topic"),
}
LIVE_WORDS = (15, 2000)
LEAST_MRR, LEAST_COMPLETENESS, MOST_HALLUCINATION, MOST_LATENCY_MS = 0.2, 0.7, 0.45, 20_000


def filled(source: Column, columns: dict[str, str]) -> Column:
    """How much of what a chunk's source asks for is filled, to four places; a field without a column is not."""
    says = lambda f: tx.non_empty(F.col(f), columns[f]).cast("int") if f in columns else F.lit(0)
    out = F.coalesce(says("source_file"), F.lit(0)).cast("double")  # an unknown source asks for its file alone
    for name, fields in LIVE_FIELDS.items():
        out = F.when(source == name, F.round(sum((F.coalesce(says(f), F.lit(0)) for f in fields), F.lit(0)) / len(fields), 4)).otherwise(out)
    return out


def chunk_facts(chunks: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Append filled, size_ok and richness (to four places) of each chunk."""
    words = tx.n_words(F.coalesce(F.col(text), F.lit("")))
    richness = F.round(metrics.text_richness(F.coalesce(F.col(text), F.lit(""))), 4)
    return chunks.select("*", filled(F.col(source), dict(chunks.dtypes)).alias("filled"), words.between(*LIVE_WORDS).alias("size_ok"), richness.alias("richness"))


def chunking_report(chunks: DataFrame, keys: list[str] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """keys, source (null: all), total, completeness, size_ok and richness, in one pass over all sources.

    A chunk without a source counts in the totals and has a row of its own, of the source ``unknown``.
    """
    keys = keys or []
    own = chunk_facts(chunks, source, text).withColumn("__source", F.coalesce(F.col(source), F.lit("unknown")))
    cols = [F.col(k) for k in keys]
    sets = own.groupingSets([[*cols, F.col("__source")], cols], *cols, F.col("__source"))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    found = sets.agg(F.count("*").alias("total"), mean("filled").alias("completeness"), mean(F.col("size_ok").cast("double")).alias("size_ok"), mean("richness").alias("richness"))
    return found.select(*keys, F.col("__source").alias("source"), "total", "completeness", "size_ok", "richness")


def live_report(scenarios: DataFrame, listed: DataFrame, counts: DataFrame, key: str = "scenario_id") -> tuple[DataFrame, Observation]:
    """(a row of every scenario with all metrics, the observation of the whole run).

    scenarios: key, mode, answer, context, keywords, length, format, expected_sources (array), latency_ms, error.
    listed: the chunks that each scenario's search gave: key, chunk_id, source, rank, score, text, grade (null: none)
    and the fields of chunks.  counts: key, grade, n, how many items of each grade there are.  A scenario that
    lists nothing has zeros.  The observation holds the gates once the report has been written or collected.
    """
    facts = chunk_facts(listed).withColumn("grade", F.when(F.col("grade") > 0, F.col("grade")))
    hit, rank = F.col("grade").isNotNull(), F.col("rank")
    dcg = lambda k: F.sum(F.when(hit & (rank <= k), metrics.gain(F.col("grade"), True) / F.log2(rank + 1)).otherwise(0.0)).alias(f"dcg{k}")
    gained = F.sum(F.when(hit & (rank <= 10), metrics.gain(F.col("grade"), False) / F.log2(rank + 1)).otherwise(0.0)).alias("gained10")
    near = lambda k, c: F.sum(F.when(c & (rank <= k), 1).otherwise(0))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    sums = facts.groupBy(key).agg(
        F.count("*").alias("chunks"), F.max(F.when(hit, 1 / rank)).alias("mrr"), dcg(5), dcg(10), gained, near(5, hit).alias("hits5"), near(5, F.lit(True)).alias("listed5"), near(10, hit).alias("hits10"),
        near(10, F.lit(True)).alias("listed10"), (F.max_by("score", -rank) - F.max_by("score", rank)).alias("gap"), F.array_sort(F.collect_set("source")).alias("namespaces"),
        mean("filled", "completeness"), mean(F.col("size_ok").cast("double"), "size_ok"), mean("richness", "richness"))
    ideal = metrics.ideals(counts, [key], 10).select(key, F.col("ideal").alias("best10"), "n_relevant")
    for k in (5, 10):
        ideal = ideal.join(metrics.ideals(counts, [key], k, linear=True).select(key, F.col("ideal").alias(f"ideal{k}")), key)
    told = metrics.answers(scenarios.join(sums, key, "left").join(ideal, key, "left").withColumn("n_chunks", F.coalesce("chunks", F.lit(0))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    spaces = F.coalesce("namespaces", F.array().cast("array<string>"))
    wanted = F.array_distinct(F.coalesce("expected_sources", F.array().cast("array<string>")))
    four = lambda c, name: F.round(zero(c), 4).alias(name)
    report = told.select(
        key, "mode", "latency_ms", "error", F.col("n_chunks").cast("long").alias("chunks_returned"), four(F.col("mrr"), "mrr"), four(F.try_divide("dcg5", "ideal5"), "ndcg_at_5"), four(F.try_divide("dcg10", "ideal10"), "ndcg_at_10"),
        four(F.try_divide("gained10", "best10"), "ndcg"), four(F.try_divide("hits5", "listed5"), "precision_at_5"), four(F.try_divide("hits10", "listed10"), "precision"), four(F.try_divide("hits10", "n_relevant"), "recall"),
        F.coalesce((F.col("hits5") > 0).cast("double"), F.lit(0.0)).alias("hit_rate_at_5"), four(F.when(F.col("chunks") > 1, F.col("gap")), "score_gap"), F.round(metrics.ratio(F.size(F.array_intersect(spaces, wanted)), F.size(wanted), 1.0), 4).alias("source_coverage"),
        F.round(F.size(spaces) / len(SOURCES), 4).alias("source_diversity"), spaces.alias("namespaces_hit"), zero(F.col("completeness")).alias("completeness"), zero(F.col("size_ok")).alias("size_ok"), zero(F.col("richness")).alias("richness"),
        four(F.col("context_utilisation"), "context_utilisation"), four(F.col("citation_coverage"), "citation_coverage"), "length_ok", four(F.col("keyword_recall"), "keyword_recall"), four(F.col("hallucination"), "hallucination"), four(F.col("plan_alignment"), "plan_alignment"))
    seen = Observation("live evaluation")
    ok = F.col("error").isNull()
    of = lambda c: F.avg(F.when(ok, F.col(c)))
    return report.observe(
        seen, F.count("*").alias("scenarios"), F.sum((~ok).cast("int")).alias("errored"), *[of(c).alias(f"avg_{c}") for c in ("latency_ms", "mrr", "ndcg_at_5", "hit_rate_at_5", "source_coverage", "completeness", "hallucination", "keyword_recall", "context_utilisation")],
        of("chunks_returned").alias("avg_chunks")), seen


def gates(observed: dict) -> dict[str, bool]:
    """The run's gates from what was observed; a run without a scenario that worked passes none."""
    value = lambda name: observed.get(f"avg_{name}")
    known = value("mrr") is not None
    out = {
        "retrieval_ok": known and value("mrr") >= LEAST_MRR and value("chunks") > 0, "chunking_ok": known and value("completeness") >= LEAST_COMPLETENESS,
        "faithfulness_ok": known and value("hallucination") < MOST_HALLUCINATION, "latency_ok": value("latency_ms") is not None and value("latency_ms") < MOST_LATENCY_MS,
    }
    return out | {"passed": all(out.values()) and not observed.get("errored")}


# --- sketches --------------------------------------------------------------------------------

def daily_sketches(df: DataFrame, keys: list[str], value: str, at: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """keys, day, n, least, most and ``sketch`` of a group's values on each day; null values are not counted."""
    own = df.where(F.col(value).isNotNull()).select(*keys, F.to_date(at).alias("day"), F.col(value).cast("double").alias("v"))
    return own.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def percentiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, n, min, max and the quantiles ``at`` {name: part} of all days together; the days' sketches are merged, no value is read again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("min"), F.max("most").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", "min", "max", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in at.items()])
