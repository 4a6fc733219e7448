"""BM25 over candidates, diversity selection, metadata boosts, rank fusion and final selection.

Everything is keyed by query, so a batch of queries is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as tx

SOURCES = ("qna", "image", "audio", "youtube", "documents", "handwritten")

# What a source's list weighs, by mode, and what its BM25 list weighs beside.
MODE_WEIGHTS = {
    "ask": {"documents": 2.2, "qna": 2.0, "audio": 1.8, "handwritten": 1.3, "image": 1.2, "youtube": 1.0},
    "quiz": {"qna": 2.8, "documents": 1.8, "handwritten": 1.5, "image": 1.3, "audio": 1.0, "youtube": 0.8},
    "summarize": {"documents": 2.2, "audio": 2.0, "youtube": 1.8, "qna": 1.5, "handwritten": 1.3, "image": 1.2},
}
BM25_WEIGHTS = {"qna": 1.4, "image": 1.2, "documents": 1.2, "handwritten": 1.1, "audio": 0.9, "youtube": 0.8}
#: The constant of rank fusion, BM25's parameters, and the most candidates of a list.
RRF_K, K1, B, EPSILON, MOST_CANDIDATES = 60, 1.5, 0.75, 0.25, 40


def lookup(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def fetch_size(dense_k: Column, bm25_k: Column) -> Column:
    return F.least(F.when(bm25_k > 0, dense_k * 3).otherwise(dense_k), F.lit(MOST_CANDIDATES))


def distinct_questions(questions: Column, threshold: float = 0.72) -> Column:
    """Of an array of texts those that are unlike every one kept before (Jaccard of their tokens under the threshold)."""
    keep = lambda kept, q: F.when(F.exists(kept, lambda k: tx.jaccard(tx.tokens(k), tx.tokens(q)) >= threshold), kept).otherwise(F.array_append(kept, q))
    return F.aggregate(questions, F.array().cast("array<string>"), keep)


def bm25(candidates: DataFrame, keys: list[str], query: str = "query", text: str = "text", chunk: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Append ``bm25`` and ``bm25_rank`` to candidates: each group's own candidates are the corpus.

    Scores are divided by the group's largest if it is positive; equal scores keep the order
    of ``rank``.  A query without tokens leaves scores 0 and the order as it was.  A group is a query's
    candidates (or a conversation's turns) and is folded once, as one array.
    """
    words = candidates.select(*keys, query, F.struct(F.col(rank).alias("rank"), F.col(chunk).alias("chunk"), tx.tokens(F.col(text)).alias("words")).alias("doc"))
    groups = words.groupBy(*keys).agg(F.array_sort(F.collect_list("doc")).alias("docs"), F.first(query).alias("query"))
    n = F.size("docs")
    # Terms of all documents in order, each as often as documents hold it: a run is a term's document frequency.
    runs = groups.withColumn("terms", F.array_sort(F.flatten(F.transform("docs", lambda d: F.array_distinct(d["words"])))))
    runs = runs.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1))))
    runs = runs.withColumn("starts", F.when(F.size("terms") > 0, F.col("starts")).otherwise(F.array().cast("array<int>")))
    weight = lambda df: F.log(n - df + 0.5) - F.log(df + 0.5)
    raw = F.transform("starts", lambda at, k: weight(F.coalesce(F.get("starts", k + 1), F.size("terms")) - at))
    mean = F.when(F.size("starts") > 0, F.aggregate(raw, F.lit(0.0), lambda a, x: a + x) / F.size("starts"))
    asked = runs.withColumn("mean", mean).withColumn("asked", tx.tokens(F.col("query"))).withColumn("avgdl", F.aggregate("docs", F.lit(0.0), lambda a, d: a + F.size(d["words"])) / n)
    rated = lambda term: F.struct(term.alias("term"), F.size(F.filter("docs", lambda d: F.array_contains(d["words"], term))).alias("df"))
    asked = asked.withColumn("rated", F.filter(F.transform("asked", rated), lambda r: r["df"] > 0))
    idf = lambda df: F.when(weight(df) < 0, F.col("mean") * EPSILON).otherwise(weight(df))

    def score(d: Column) -> Column:
        def part(r: Column) -> Column:
            tf = F.size(F.filter(d["words"], lambda w: w == r["term"]))
            return idf(r["df"]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(d["words"]) / F.col("avgdl")))

        return F.aggregate("rated", F.lit(0.0), lambda a, r: a + F.when(F.array_contains(d["words"], r["term"]), part(r)).otherwise(0.0))

    scored = asked.select(*keys, F.transform("docs", lambda d: F.struct(d["rank"].alias("rank"), d["chunk"].alias("chunk"), score(d).alias("raw"))).alias("scored"))
    scored = scored.withColumn("top", F.array_max(F.transform("scored", lambda x: x["raw"])))
    shown = F.transform("scored", lambda x: F.struct((-F.round(F.when(F.col("top") > 0, x["raw"] / F.col("top")).otherwise(x["raw"]), 6)).alias("bm25"), x["rank"].alias("rank"), x["chunk"].alias("chunk")))
    ranked = scored.select(*keys, F.posexplode(F.array_sort(shown)).alias("at", "s")).select(*keys, F.col("s.chunk").alias(chunk), *([F.col("s.rank").alias(rank)] if rank != chunk else []), (-F.col("s.bm25")).alias("bm25"), (F.col("at") + 1).alias("bm25_rank"))
    return candidates.join(ranked, list(dict.fromkeys([*keys, chunk, rank]))).select(*candidates.columns, "bm25", "bm25_rank")


def diverse(candidates: DataFrame, keys: list[str], k: Column, weight: Column, strict_same_file: bool = False) -> DataFrame:
    """Maximal marginal relevance within each group; appends ``mmr_rank``, and drops what is not selected.

    Needs chunk_id, score, rank, source_file, file_name and place (the chunk's index).  A group of at
    most k stays in its order.  Two chunks are alike by 0.85 in one file at most two places apart, by
    0.5 in one file, else by the product of their scores.  Files that are both unnamed count as
    one unless ``strict_same_file``.  A group holds at most MOST_CANDIDATES rows, so it fits one array.
    """
    packed = candidates.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id", "source_file", "file_name", "place"))).alias("all"), F.max(k).alias("k"), F.max(weight).alias("lambda"))
    size = F.size("all")

    def same(a: Column, b: Column) -> Column:
        if strict_same_file:
            eq = lambda f: F.coalesce((a[f] == b[f]) & (a[f] != ""), F.lit(False))
        else:
            eq = lambda f: F.coalesce(a[f], F.lit("")) == F.coalesce(b[f], F.lit(""))
        return eq("source_file") | eq("file_name")

    def alike(i: Column, j: Column) -> Column:
        a, b = F.get("all", i), F.get("all", j)
        near = F.coalesce(F.abs(a["place"] - b["place"]) <= 2, F.lit(False))
        return F.when(same(a, b) & near, 0.85).when(same(a, b), 0.5).otherwise(a["score"] * b["score"])

    def best(values: Column) -> Column:
        """Of (value, -place) structs the largest: the first of equal values."""
        return -F.array_max(values)["at"]

    places = F.sequence(F.lit(0), size - 1)
    seed = best(F.transform(places, lambda i: F.struct(F.get("all", i)["score"].cast("double").alias("value"), (-i).alias("at"))))

    def grow(chosen: Column, _: Column) -> Column:
        rest = F.array_except(places, chosen)

        def value(i: Column) -> Column:
            worst = F.array_max(F.transform(chosen, lambda j: alike(i, j)))
            return F.struct((F.col("lambda") * F.get("all", i)["score"] - (1 - F.col("lambda")) * F.greatest(worst, F.lit(0.0))).cast("double").alias("value"), (-i).alias("at"))

        return F.array_append(chosen, best(F.transform(rest, value)))

    chosen = F.when(size <= F.col("k"), places).otherwise(F.when(F.col("k") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.col("k"), F.lit(2)).cast("int")), F.array(seed), grow)).otherwise(F.array(seed)))
    order = packed.select(*keys, "all", F.posexplode(chosen).alias("at", "i")).select(*keys, F.get("all", F.col("i"))["chunk_id"].alias("chunk_id"), (F.col("at") + 1).alias("mmr_rank"))
    return candidates.join(order, [*keys, "chunk_id"])


def metadata_boost(source: Column, signals: Column, compat: bool = False) -> Column:
    """The product of the factors that a chunk's metadata earns it.

    Reads the columns marks_hint, year_hint, chunk_type, has_equations, content_type, confidence,
    ocr_confidence, has_formula, strategy, avg_confidence and has_table.  ``compat`` boosts any year hint,
    also the -1 that stands for none.
    """
    told = lambda *words: F.exists(F.coalesce(signals, F.array().cast("array<string>")), lambda s: F.lower(s).rlike("|".join(words)))
    year = F.col("year_hint").isNotNull() & ((F.col("year_hint") != 0) if compat else (F.col("year_hint") > 0))
    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    rules = {
        "qna": [(F.col("marks_hint") > 0, 1.12), (year, 1.05), (F.col("chunk_type").isin("single_qa", "multi_qa") & told("exam", "question"), 1.10)],
        "handwritten": [(c("has_equations") & told("equation", "formula"), 1.15), (F.col("content_type") == "equation", 1.08), (F.coalesce("confidence", F.lit(1.0)) < 0.6, 0.85)],
        "image": [(F.coalesce("ocr_confidence", F.lit(80.0)) / 100 < 0.65, 0.80), (c("has_formula") & told("formula", "equation"), 1.12)],
        "audio": [(F.col("strategy") == "concept_block", 1.08), (F.coalesce("avg_confidence", F.lit(0.8)) < 0.7, 0.90)],
        "documents": [(c("has_table") & told("table", "comparison"), 1.10)],
    }
    boost = F.lit(1.0)
    for name, factors in rules.items():
        for test, factor in factors:
            boost = boost * F.when((source == name) & F.coalesce(test, F.lit(False)), factor).otherwise(1.0)
    return boost


def fuse(ranked: DataFrame, keys: list[str], chunk: str = "chunk_id", weight: str = "weight", boost: str = "boost", rank: str = "rank", list_no: str = "list_no") -> DataFrame:
    """Reciprocal rank fusion: keys, chunk, rrf, first_seen (the place that settles ties) and methods if there is such a column."""
    methods = [F.array_sort(F.collect_set("method")).alias("methods")] if "method" in ranked.columns else []
    share = F.col(weight) * F.col(boost) / (RRF_K + F.col(rank))
    return ranked.groupBy(*keys, chunk).agg(F.sum(share).alias("rrf"), F.min(F.col(list_no) * 1000 + F.col(rank)).alias("first_seen"), *methods)


def select_top(fused: DataFrame, keys: list[str], k: int, chunk: str = "chunk_id") -> DataFrame:
    """The k best of each query, scores rounded to four places and ranked anew by them; equals keep their order."""
    own = Window.partitionBy(*keys)
    first = fused.withColumn("at", F.row_number().over(own.orderBy(F.desc(F.round("rrf", 10)), "first_seen", chunk))).where(F.col("at") <= k)
    scored = first.withColumn("score", F.round("rrf", 4))
    return scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "at"))).drop("at", "rrf", "first_seen")


def breakdown(selected: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    counts = selected.groupBy(*keys, source).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("sources"))


def context(selected: DataFrame, keys: list[str], divider: str = "\n\n---\n\n") -> DataFrame:
    """Numbered blocks of citation, type, score, methods and text, in rank order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("citation", F.lit("")), F.lit(" | "), F.coalesce("chunk_type", F.lit("")), F.lit(" | score "), F.col("score").cast("string"), F.lit("\n"), F.coalesce("display_text", F.lit("")))
    return selected.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda s: s["block"]), divider).alias("context"))
