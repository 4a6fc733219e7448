"""Sinks: chunk tables by course and namespace, upserts, shaping and statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How long texts and lists may be in the store.
TEXT_LIMITS = {"raw_text": 8000, "tables_text": 4000, "image_summaries": 8000, "text_preview": 300, "gemini_summary": 1000, "gemini_topic": 200}
LIST_LIMITS = {"questions": 30, "answers": 30, "concepts": 50, "keywords": 50, "gemini_keywords": 30, "gemini_content_signals": 20}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where none is set, a local session (one process, as in tests) gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: tables are kept in a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ragloom-shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, whose files go when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/ragloom-{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def create_table(spark: SparkSession, name: str, ddl: str) -> None:
    """A chunk table parted by course and namespace, unless it is there.  ``ddl`` must name both columns."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet PARTITIONED BY (course_id, namespace)")


def latest(existing: DataFrame | None, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The last version of each key; of equal versions the new rows win.  Only ids meet in the comparison's window."""
    tagged = new.withColumn("__new", F.lit(1))
    both = tagged if existing is None else existing.withColumn("__new", F.lit(0)).unionByName(tagged, allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__at", at).where("__at = 1").drop("__at", "__new")


def upsert(spark: SparkSession, table: str, new: DataFrame, keys: tuple[str, ...] = ("course_id", "namespace", "chunk_id"), version: str = "version") -> None:
    """Merge rows into a parted table: only the partitions that new rows touch are read and written anew."""
    touched = new.select("course_id", "namespace").distinct()
    existing = spark.table(table).join(F.broadcast(touched), ["course_id", "namespace"], "left_semi")
    merged = latest(existing, new, list(keys), version).select(spark.table(table).columns)
    kept = staged(merged)  # before its own partitions are overwritten
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        kept.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(name, before)


def shaped(chunks: DataFrame) -> DataFrame:
    """Cut texts and lists to the store's limits, numbers in lists to text, and absent hints to -1.

    The limits are the store's own; the whole texts stay in the table that ``chunks`` came from, under the same id.
    """
    out = chunks
    for name, kind in chunks.dtypes:
        value: Column | None = None
        if name in TEXT_LIMITS and kind == "string":
            value = F.substring(name, 1, TEXT_LIMITS[name])
        elif kind.startswith("array"):
            value = F.slice(name, 1, LIST_LIMITS[name]) if name in LIST_LIMITS else F.col(name)
            value = F.transform(value, lambda x: x.cast("string")) if kind in ("array<int>", "array<bigint>") else value
        elif name in ("year_hint", "marks_hint"):
            value = F.coalesce(F.col(name), F.lit(-1))
        if value is not None:
            out = out.withColumn(name, value)
    return out


def store_records(chunks: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(F.col(id).alias("id"), F.col(text).alias("text"), F.struct(*[c for c in chunks.columns if c != text]).alias("metadata"))


def stats(chunks: DataFrame, namespace: str = "namespace", vector: str = "embedding") -> DataFrame:
    """Vectors and dimension of each namespace, and of all together (namespace null)."""
    return chunks.rollup(namespace).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dimension"))


def seed(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records, counts by source) of several sources' chunks; records without id are dropped."""
    union = None
    for source, df in parts.items():
        own = store_records(df).select("id", "text", F.lit(source).alias("source"), F.to_json("metadata").alias("metadata"))
        union = own if union is None else union.unionByName(own)
    kept = union.where("id is not null and id <> ''")
    return kept, kept.groupBy("source").agg(F.count("*").alias("n"))


def chunk_dump(chunks: DataFrame, path: str, file: str = "source_file", error: str = "error") -> DataFrame:
    """Write the chunks of files without an error as JSON under ``path``; gives the rejects: file and error, one row each.

    A file with an error in any of its rows is rejected as a whole.
    """
    bad = chunks.where(F.col(error).isNotNull()).groupBy(file).agg(F.min(error).alias(error))
    chunks.join(bad.select(file), file, "left_anti").drop(error).write.mode("overwrite").json(path)
    return bad
