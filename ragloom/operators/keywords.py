"""Top terms of a text or a group of texts, by frequency, ties by first occurrence."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as tx

#: Characters of a row's matches that are split at once.
PIECE_CHARS = 1_000_000


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def terms(text: Column, pattern: str, stopwords: list[str]) -> Column:
    return F.filter(matches(text, pattern), lambda t: ~t.isin(*stopwords))


def top_terms(df: DataFrame, keys: list[str], text: str, pattern: str, stopwords: list[str], most: int, order: str | None = None, joiner: str = ", ", out: str = "keywords") -> DataFrame:
    """keys and ``out``: the ``most`` most frequent terms of each group, joined.

    ``order``: a column that orders the texts of a group; terms are placed by it and by their place in
    the text.  Counts are summed before they meet, so a group of any size is spread over tasks;
    a group without terms has the empty text.
    """
    exploded = df.select(*keys, F.coalesce(F.col(order), F.lit(0)).alias("__order") if order else F.lit(0).alias("__order"), F.posexplode(terms(F.col(text), pattern, stopwords)).alias("__at", "term"))
    counted = exploded.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min(F.struct("__order", "__at")).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first", "term"))).where(F.col("rank") <= most)
    joined = ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), joiner).alias(out))
    return df.select(*keys).distinct().join(joined, keys, "left").withColumn(out, F.coalesce(out, F.lit("")))


def row_terms(df: DataFrame, text: str, pattern: str, stopwords: list[str], most: int, joiner: str = ", ", out: str = "keywords") -> DataFrame:
    """Append the top terms of each row's own text, without a shuffle: counted in one pass, in the order of their first places, and never sorted.

    ``pattern`` is Java's, as in top_terms(); its matches go to Python joined by NUL, so a match that holds a NUL counts as its parts.
    """
    stop, step = frozenset(stopwords), PIECE_CHARS

    def best(joined: str) -> str:
        counts: Counter[str] = Counter()
        at = 0
        while at <= len(joined):
            end = joined.find("\0", at + step)
            end = len(joined) if end < 0 else end
            counts.update(joined[at:end].split("\0"))
            at = end + 1
        for term in counts.keys() & stop:
            del counts[term]
        return joiner.join(t for t, _ in counts.most_common(most))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((best(t.as_py()) for t in texts), pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.array_join(matches(F.col(text), pattern), "\0")))


def document_keywords(df: DataFrame, id: str = "doc_id", text: str = "text", most: int = 12) -> DataFrame:
    """Of each row by itself: id and keywords."""
    return row_terms(df.select(id, text), text, "[a-z]{4,}", tx.KEYWORD_STOPWORDS, most).select(id, "keywords")


def caption_tags(df: DataFrame, id: str, text: str = "text", most: int = 8) -> DataFrame:
    return row_terms(df.select(id, text), text, r"\b[a-z][a-z_-]{3,}\b", tx.CAPTION_STOPWORDS, most, out="tags").select(id, "tags")


def topic_labels(df: DataFrame, keys: list[str], text: str = "text", most: int = 5, order: str | None = None) -> DataFrame:
    """The label of a cluster of texts; ``general`` without terms."""
    found = top_terms(df, keys, text, "[a-z]{4,}", tx.TOPIC_STOPWORDS, most, order, " / ", "topic_label")
    return found.withColumn("topic_label", F.when(F.col("topic_label") == "", "general").otherwise(F.col("topic_label")))
