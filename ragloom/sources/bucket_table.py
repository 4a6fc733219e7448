"""A chunk table of hashed buckets with a manifest of versions: an upsert rewrites the buckets it meets and no others.

    table = BucketTable.create(spark, path, "course_id string, namespace string, chunk_id string, version long, text string")
    table.upsert(rows)                 # the last version of each key wins
    table.upsert(rows, wins="first")   # the first one stays
    table.read(), table.read(commit=3)

Rows live in ``data/commit=N/course_id=../namespace=../bucket=..``; ``manifest/N`` says for every bucket which commit's files
are its rows.  An upsert reads the buckets that its rows hash to, merges, writes them anew under the next commit, and then
writes the manifest; until that is there, readers see the table as it was, and a failed upsert leaves files that no
manifest names (vacuum() removes them).  Two upserts at once can't both write a manifest: the second fails and is run again.

Of rows with equal keys that with the greatest version stays, of equal versions a new one before one in the table
(``wins="first"``: the least version, the one in the table).  A null version is the least of all.  Rows with a null course,
namespace or id are rows of a key like others.  An upsert of no rows changes nothing; columns that new rows lack are null.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.sources.writers import staged

PLACE = ["course_id", "namespace", "bucket"]


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = self.spark.read.parquet(f"{path}/table").first()
        self.schema, self.buckets = T.StructType.fromJson(json.loads(held["schema"])), held["buckets"]
        self.keys, self.version = list(held["keys"]), held["version"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...] = ("course_id", "namespace", "chunk_id"), version: str = "version", buckets: int = 16) -> BucketTable:
        """A table of these columns; ``buckets``: of each course and namespace, for good."""
        schema = T.StructType.fromDDL(ddl)
        if missing := {*keys, version, "course_id", "namespace"} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        if taken := {"bucket", "commit"} & set(schema.names):
            raise ValueError(f"reserved names: {', '.join(sorted(taken))}")
        spark.createDataFrame([(schema.json(), buckets, list(keys), version)], "schema string, buckets int, keys array<string>, version string").coalesce(1).write.parquet(f"{path}/table")
        return cls(spark, path)

    def commits(self) -> list[int]:
        """Numbers of the manifests that are whole."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, commit: int | None = None) -> DataFrame:
        """course_id, namespace, bucket and the commit that holds its rows."""
        commits = self.commits()
        if commit is not None and commit not in commits:
            raise ValueError(f"no commit {commit}")
        schema = "course_id string, namespace string, bucket int, commit long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest/{commits[-1] if commit is None else commit}") if commits else self.spark.createDataFrame([], schema)

    def rows_of(self, places: DataFrame) -> DataFrame:
        """Rows of these buckets at these commits; the scan's partitions are pruned by the join."""
        fields = [f for f in self.schema.fields if f.name not in PLACE]
        schema = T.StructType([*fields, T.StructField("commit", T.LongType()), T.StructField("course_id", T.StringType()), T.StructField("namespace", T.StringType()), T.StructField("bucket", T.IntegerType())])
        data = self.spark.read.schema(schema).parquet(f"{self.path}/data").alias("d")
        p = F.broadcast(places).alias("p")  # one row a bucket
        same = (F.col("d.commit") == F.col("p.commit")) & (F.col("d.bucket") == F.col("p.bucket")) & F.col("d.course_id").eqNullSafe(F.col("p.course_id")) & F.col("d.namespace").eqNullSafe(F.col("p.namespace"))
        return data.join(p, same).select(*[F.col(f"d.`{n}`") for n in self.schema.names], "d.bucket")

    def read(self, commit: int | None = None) -> DataFrame:
        """All rows, as of a commit or the last one."""
        if not self.commits():
            return self.spark.createDataFrame([], self.schema)
        return self.rows_of(self.manifest(commit)).select(self.schema.names)

    def upsert(self, new: DataFrame, wins: str = "last") -> dict[str, int]:
        """Merge rows; gives the commit, and how many buckets were rewritten of how many."""
        if wins not in ("last", "first"):
            raise ValueError(f"unknown rule {wins!r}")
        kinds = {f.name: f.dataType for f in self.schema.fields}
        own = new.select(*[(F.col(f"`{n}`") if n in new.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")
        own = staged(own.withColumn("bucket", bucket))
        touched = staged(own.select(*PLACE).distinct())
        n = touched.count()
        commits = self.commits()
        before = self.manifest()
        if not n:
            return {"commit": commits[-1] if commits else 0, "rewritten": 0, "buckets": before.count()}
        same = (before["bucket"] == touched["bucket"]) & before["course_id"].eqNullSafe(touched["course_id"]) & before["namespace"].eqNullSafe(touched["namespace"])
        both = own.withColumn("__new", F.lit(1))
        if commits:
            met = before.join(touched, same, "left_semi")
            both = both.unionByName(self.rows_of(met).withColumn("__new", F.lit(0)))
        row = F.struct(*self.schema.names)
        rank = F.struct(F.col(self.version).isNotNull().cast("int"), F.col(self.version), F.col("__new"), F.xxhash64(*self.schema.names))
        best = F.max_by(row, rank) if wins == "last" else F.min_by(row, rank)
        merged = both.groupBy(*dict.fromkeys([*PLACE, *self.keys])).agg(best.alias("__row")).select("__row.*", "bucket")
        commit = (commits[-1] if commits else 0) + 1
        merged.repartition(*PLACE).write.partitionBy("course_id", "namespace", "bucket").parquet(f"{self.path}/data/commit={commit}", mode="overwrite")
        stays = before.join(touched, same, "left_anti")
        stays.unionByName(touched.withColumn("commit", F.lit(commit).cast("long"))).coalesce(1).write.parquet(f"{self.path}/manifest/{commit}")
        return {"commit": commit, "rewritten": n, "buckets": self.manifest(commit).count()}

    def vacuum(self) -> int:
        """Remove the files that the last manifest doesn't name, older manifests with them; gives how many buckets' folders went."""
        commits = self.commits()
        if not commits:
            return 0
        live = {(r["commit"], r["course_id"], r["namespace"], r["bucket"]) for r in self.manifest().collect()}  # one row a bucket
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(conf)
        unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName

        def value(p: object) -> str | None:
            text = unescape(p.getName().partition("=")[2])
            return None if text == "__HIVE_DEFAULT_PARTITION__" else text

        gone = 0
        for c in fs.listStatus(root):
            for course in (s for s in fs.listStatus(c.getPath()) if s.isDirectory()):
                for space in (s for s in fs.listStatus(course.getPath()) if s.isDirectory()):
                    for b in (s for s in fs.listStatus(space.getPath()) if s.isDirectory()):
                        if (int(value(c.getPath())), value(course.getPath()), value(space.getPath()), int(value(b.getPath()))) not in live:
                            fs.delete(b.getPath(), True)
                            gone += 1
        for c in commits[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{c}"), True)
        return gone
