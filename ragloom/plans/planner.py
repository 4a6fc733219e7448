"""A rule planner for batches of questions, and the retriever that runs the plans.

The planner stands in where no language model is at hand: it weighs sources by mode and
category, and sizes their lists.  Any DataFrame with the same columns serves as a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators import ranking as rk
from ragloom.operators.vectors import dense_top_k
from ragloom.sources.writers import staged

# Sizes of dense lists (from, to), who gets a BM25 list and diversity selection, and what categories change.
DENSE_K = {"qna": (4, 8), "image": (3, 6), "audio": (6, 12), "youtube": (5, 8), "documents": (5, 9), "handwritten": (3, 6)}
BM25_K = {"qna": 5, "image": 4, "audio": 2, "youtube": 0, "documents": 5, "handwritten": 2}
USE_MMR = {"qna": False, "image": True, "audio": True, "youtube": True, "documents": True, "handwritten": False}
CATEGORY_FACTORS = {
    "visual_or_diagram": {"image": 1.5, "youtube": 1.2},
    "problem_or_derivation": {"qna": 1.3, "handwritten": 1.4},
    "worked_example": {"handwritten": 1.5, "qna": 1.3, "audio": 1.2},
    "comparison": {"documents": 1.3, "youtube": 1.2},
    "procedural_steps": {"audio": 1.3, "youtube": 1.3},
}
#: Words that betray a question's category, first match first.
CATEGORY_WORDS = {
    "visual_or_diagram": "diagram|figure|draw|image|picture|plot",
    "problem_or_derivation": "derive|prove|solve|calculate|compute|find the",
    "worked_example": "example|worked|illustrate",
    "comparison": "compare|difference|versus|vs",
    "procedural_steps": "steps|how to|procedure|process of",
}
MMR_LAMBDA = 0.6
#: Numbers of lists are apart by this for each source; they only settle ties.
MOST_SUB_QUERIES = 64


def category(query: Column) -> Column:
    out = F.lit("explanation")
    for name, words in reversed(CATEGORY_WORDS.items()):
        out = F.when(F.lower(query).rlike(rf"\b({words})\b"), name).otherwise(out)
    return out


def plan(queries: DataFrame) -> DataFrame:
    """One row for each query and source: weight, dense_k, bm25_k, use_mmr, mmr_k, lambda.

    queries: query_id, query, mode, and optionally complexity ("basic", "intermediate", "advanced").
    """
    complexity = F.col("complexity") if "complexity" in queries.columns else F.lit("intermediate")
    rows = F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(BM25_K[s]).alias("bm25_k"), F.lit(USE_MMR[s]).alias("use_mmr")) for s, (lo, hi) in DENSE_K.items()
    ])
    own = queries.select("query_id", "query", "mode", category(F.col("query")).alias("category"), complexity.alias("complexity"), F.explode(rows).alias("r")).select("*", "r.*").drop("r")
    weight = F.lit(0.0)
    for mode, table in rk.MODE_WEIGHTS.items():
        weight = F.when(F.col("mode") == mode, rk.lookup(table, F.col("source"))).otherwise(weight)
    for name, factors in CATEGORY_FACTORS.items():
        for source, factor in factors.items():
            weight = weight * F.when((F.col("category") == name) & (F.col("source") == source), factor).otherwise(1.0)
    size = F.when(F.col("complexity") == "basic", F.col("lo")).when(F.col("complexity") == "advanced", F.col("hi")).otherwise((F.col("lo") + F.col("hi")) / 2)
    size = size * F.when((F.col("mode") == "quiz") & (F.col("source") == "qna"), 1.5).when(F.col("mode") == "summarize", 1.2).otherwise(1.0)
    dense = F.ceil(size).cast("int")
    return own.select("query_id", "query", "mode", "category", "source", F.round(weight, 4).alias("weight"), dense.alias("dense_k"), "bm25_k", "use_mmr", dense.alias("mmr_k"), F.lit(MMR_LAMBDA).alias("lambda"))


def retrieve(queries: DataFrame, plans: DataFrame, chunks: DataFrame, top_k: int = 8, signals: str | None = None, sub_queries: DataFrame | None = None) -> DataFrame:
    """The fused top chunks of every query: query_id, chunk_id, source, score, rank and methods.

    queries: query_id, query, embedding.  ``sub_queries``: query_id, sub (from 0), query, embedding; each asks every
    source of its query's plan, and all their lists are fused.  Without them a query asks for itself.  chunks: chunk_id, source, text, embedding and, as far as there
    are any, the metadata that boosts and diversity read.  A dense list of each source, diversity
    selection, BM25 over what it left, boosts, rank fusion, selection.
    """
    for name, kind in {"source_file": "string", "file_name": "string", "place": "int", "marks_hint": "int", "year_hint": "int", "chunk_type": "string", "has_equations": "boolean", "content_type": "string", "confidence": "double", "ocr_confidence": "double", "has_formula": "boolean", "strategy": "string", "avg_confidence": "double", "has_table": "boolean"}.items():
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    budget = plans.withColumn("fetch_k", rk.fetch_size(F.col("dense_k"), F.col("bm25_k")))
    keys = ["query_id", "sub", "source"]
    asked = queries.withColumn("sub", F.lit(0)) if sub_queries is None else sub_queries
    asked = asked.select(F.struct("query_id", F.col("sub").cast("int").alias("sub")).alias("asked"), F.col("query").alias("asked_query"), "embedding")
    dense = dense_top_k(asked, chunks, rk.MOST_CANDIDATES, query_id="asked", by=["source"]).join(asked.select("asked", "asked_query"), "asked")
    dense = dense.select("asked.query_id", "asked.sub", "asked_query", "source", "chunk_id", "score", "rank")
    # A bounded number of candidates a query and source; they are read several times from here on.
    fetched = staged(dense.join(budget, ["query_id", "source"]).withColumn("query", F.col("asked_query")).drop("asked_query").where(F.col("rank") <= F.col("fetch_k")).join(chunks.drop("embedding"), ["source", "chunk_id"]))
    kept = rk.diverse(fetched.where("use_mmr"), keys, F.col("mmr_k"), F.col("lambda"))
    plain = fetched.where("not use_mmr").withColumn("mmr_rank", F.col("rank"))
    pool = kept.unionByName(plain).withColumn("dense_rank", F.col("mmr_rank"))
    sources = F.create_map(*[F.lit(x) for i, s in enumerate(rk.SOURCES) for x in (s, i)])
    given = F.col(signals) if signals else F.array().cast("array<string>")
    boosted = staged(pool).withColumn("boost", rk.metadata_boost(F.col("source"), given)).withColumn("no", (F.element_at(sources, F.col("source")) * MOST_SUB_QUERIES + F.col("sub")) * 2)
    lists = boosted.where(F.col("dense_rank") <= F.col("dense_k")).select(*keys, "chunk_id", F.col("dense_rank").alias("rank"), "weight", "boost", F.col("no").alias("list_no"), F.when(F.col("use_mmr"), "mmr").otherwise("dense").alias("method"))
    words = rk.bm25(boosted.where("bm25_k > 0"), keys, rank="dense_rank").where(F.col("bm25_rank") <= F.col("bm25_k"))
    sparse = words.select(*keys, "chunk_id", F.col("bm25_rank").alias("rank"), (F.col("weight") * rk.lookup(rk.BM25_WEIGHTS, F.col("source"))).alias("weight"), "boost", (F.col("no") + 1).alias("list_no"), F.lit("bm25").alias("method"))
    fused = rk.fuse(lists.unionByName(sparse).drop("sub"), ["query_id", "source"])
    return rk.select_top(fused, ["query_id"], top_k)
