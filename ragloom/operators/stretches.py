"""Ordered work over keys that may hold a third of all rows: rows are dealt to stretches of (key, order).

A stretch is worked through by itself; what lies before it comes from one row for each key and stretch.  Stretches are
kept (staged), so that every job sees the same ones.  Rows whose order ties stay in one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.sources.writers import staged

PART = "__part"


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``__part``, the stretch of (keys, order) that holds each."""
    return staged(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def joined(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the one of its key and stretch; null keys are keys."""
    same = F.col(f"r.{PART}") == F.col(f"e.{PART}")
    for k in keys:
        same &= F.col(f"r.`{k}`").eqNullSafe(F.col(f"e.`{k}`"))
    return rows.alias("r").join(edges.alias("e"), same)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Append ``out``: the last ``value`` that is not null, of a row's key up to and with the row, in ``order``."""
    held = dealt(rows.withColumn("__value", value), keys, order)
    own = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    lasts = held.groupBy(*keys, PART).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), at)).alias("__last"))
    lasts = lasts.withColumn("__last", F.last("__last", ignorenulls=True).over(before))
    near = held.withColumn("__near", F.last("__value", ignorenulls=True).over(own))
    return joined(near, lasts, keys).select(*[F.col(f"r.`{c}`") for c in rows.columns], F.coalesce("r.__near", "e.__last").alias(out))


def placed(rows: DataFrame, keys: list[str], order: list[str], at: str = "__at", total: str = "__n") -> DataFrame:
    """Append a row's place among its key's rows in ``order``, from 0, and how many they are."""
    held = dealt(rows, keys, order)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*keys, PART).agg(F.count("*").alias("__size"))
    sizes = sizes.select(*keys, PART, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.sum("__size").over(Window.partitionBy(*keys)).alias("__total"))
    own = held.withColumn("__own", F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) - 1)
    return joined(own, sizes, keys).select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("r.__own") + F.col("e.__before")).alias(at), F.col("e.__total").alias(total))
