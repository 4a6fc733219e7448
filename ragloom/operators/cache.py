"""A semantic result cache as tables: exact and nearest lookups, retention, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as tx
from ragloom.operators.vectors import cosine

#: Likeness of a hit, entries that a bucket keeps, and seconds that an entry lives.
THRESHOLD, MOST_ENTRIES, TTL = 0.90, 200, 24 * 3600
MODES = ("ask", "quiz", "summarize")


def exact_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id and entry_id of the newest entry with the same course, mode and normalised query.

    queries: query_id, course, mode, query.  entries: entry_id, course, mode, query, created.
    """
    own = queries.select("query_id", "course", "mode", tx.query_hash(F.col("query"), F.col("mode")).alias("hash"))
    known = entries.withColumn("hash", tx.query_hash(F.col("query"), F.col("mode"))).groupBy("course", "mode", "hash").agg(F.max(F.struct("created", "entry_id")).alias("newest"))
    return own.join(known, ["course", "mode", "hash"]).select("query_id", F.col("newest.entry_id").alias("entry_id"), F.lit(1.0).alias("similarity"))


def nearest_hits(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The most similar entry of the same course and mode, the newest of equals, if it reaches the threshold.

    A bucket holds at most MOST_ENTRIES entries after retention(), so this join is bounded.
    """
    pairs = queries.select("query_id", "course", "mode", F.col("embedding").alias("q")).join(entries.select("entry_id", "course", "mode", "created", F.col("embedding").alias("e")), ["course", "mode"])
    scored = pairs.select("query_id", "entry_id", "created", F.round(cosine(F.col("q"), F.col("e")), 4).alias("similarity"))
    best = scored.groupBy("query_id").agg(F.max(F.struct("similarity", "created", "entry_id")).alias("b"))
    return best.select("query_id", F.col("b.entry_id").alias("entry_id"), F.col("b.similarity").alias("similarity")).where(F.col("similarity") >= threshold)


def lookup(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact hits, and for the other queries nearest ones."""
    exact = exact_hits(queries, entries)
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    return exact.withColumn("how", F.lit("exact")).unionByName(nearest_hits(rest, entries, threshold).withColumn("how", F.lit("nearest")))


def retention(entries: DataFrame, now: Column, most: int = MOST_ENTRIES, ttl: int = TTL) -> DataFrame:
    """Entries that live: the newest of each course and mode, none older than ``ttl`` seconds."""
    newest = F.row_number().over(Window.partitionBy("course", "mode").orderBy(F.desc("created"), F.desc("entry_id")))
    fresh = entries.where(F.col("created").cast("long") > now.cast("long") - ttl)
    return fresh.withColumn("__at", newest).where(F.col("__at") <= most).drop("__at")


def without_course(entries: DataFrame, course: str) -> DataFrame:
    return entries.where(~F.col("course").eqNullSafe(course))


def stats(entries: DataFrame) -> DataFrame:
    """Entries by mode; a mode without any has 0."""
    modes = entries.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return modes.join(entries.groupBy("mode").agg(F.count("*").alias("n")), "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("n"))


#: The shape of a cached result's chunks.
CHUNKS = "array<struct<chunk_id:string,source:string,score:double,rank:int,display_text:string,citation:string>>"


def rehydrated(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """The chunks of hit entries (``chunks``: JSON): query_id, and a row for each with its text (from the display text) and defaults for what is missing."""
    held = hits.join(entries.select("entry_id", F.from_json("chunks", CHUNKS).alias("c")), "entry_id").select("query_id", F.posexplode("c").alias("at", "c"))
    c = lambda name: F.col(f"c.{name}")
    return held.select("query_id", c("chunk_id").alias("chunk_id"), F.coalesce(c("source"), F.lit("documents")).alias("source"), F.coalesce(c("score"), F.lit(0.0)).alias("score"), F.coalesce(c("rank"), F.col("at") + 1).alias("rank"), F.coalesce(c("display_text"), F.lit("")).alias("text"), F.coalesce(c("citation"), F.lit("")).alias("citation"))
