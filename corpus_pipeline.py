"""A corpus pipeline of five of the training-data operators, over the table documents.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and
returns a DataFrame that run() writes to the shared folder and reads again for the next.
All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, language_id, near_dedup, piece_codec, secret_scan
from ragloom.llm.queries import tokenizer_path
from ragloom.llm.support import written

#: A document goes if its language can't be told, or if its label says another language than the net with at least this probability.
SURE = 0.99


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that the net places, surely, in another language than they claim.

    The net learns from the labelled rows of ``docs`` outside fold 0.  A row without a label, or with one that the net
    has not learned, is judged by its text alone; without any labelled text so are all.
    """
    fold = F.coalesce(language_id.fold_of(F.col("doc_id")), F.lit(0))
    net = language_id.fit(docs.where(fold != 0))
    if not net.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    seen = language_id.predict(docs, net, label="__lang", score="__score")
    wrong = F.col("lang").isin(net.labels) & (F.col("lang") != F.col("__lang")) & (F.col("__score") >= SURE)
    return seen.where((F.col("__lang") != "und") & ~F.coalesce(wrong, F.lit(False))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each group of near copies (five words, similarity 0.8)."""
    groups = near_dedup.near_duplicates(docs)
    gone = groups.where("not kept").select("doc_id").distinct()
    unique = docs.join(gone, "doc_id", "left_anti")
    # Rows that repeat an id are equal or, with other texts, documents of their own: of each text the row stays whose
    # other columns are least, in their order.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(None)
    one = unique.groupBy("doc_id", "text").agg(least.alias("__row"))
    return one.select(*[F.col(f"__row.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with an item of benchmark."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, and n_chars follows its text."""
    cleaned = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, and digests of ids and decoded text."""
    return piece_codec.digests(docs, tokenizer_path("piece_bpe_32k.model"), release=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("secrets", secrets), ("pieces", pieces)]

#: The net, the near-duplicate components and the piece encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
