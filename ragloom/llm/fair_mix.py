"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Sources, in the order of their values (code points, null last), weigh 1, 2, 3 and again.  They share the budget,
which is the size of all documents (words ``[^\\x20\\x09-\\x0D]+``), by weight, but no target exceeds ``most_times``
times its source's size; what a source can't use is reshared by weight.  That is a water level: the level at which
the targets min(bound, level * weight) sum to the budget.

Every source's documents stand in an order that a hash of their ids shuffles, and are queued again in that order up to
``most_times`` times.  A copy's virtual finish time is what its source has queued up to its end, divided by the
source's target.  All copies are range-sorted by finish time (then source, then queue) and taken until the budget is
full.  So each source takes its target but for about one document, and a mix cut short anywhere has the same shares.

At scale: texts are read once and become sizes; of the rest a row holds numbers and ids.  Rows that agree in source, id
and size are one group with a count, dealt to blocks of BLOCK rows, so that a value that a third of all rows share (or
null) is spread.  A source's queue is cut to ranges of its hash, each summed by itself; only one row a range is summed
across them.  Finish times are range-sorted and summed by range; rows are summed one by one in the range alone where
the budget ends.  Sources are ranked and levelled by ranges as well, however many they are.

Rows with a null or empty text, or one of separators alone, have size 0 and are taken 0 times; null ids and repeated
rows are documents like others, each row with its own copies.  A table without words takes nothing and has targets of
0; an empty table gives no rows.  Other columns are not looked at.  Equal tables give equal mixes, however they are
partitioned: rows that agree in id, source and size, and are queued in any order, can't be told apart in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.support import spread, written

#: Rows of one group that one block holds.
BLOCK = 1000
#: Blocks in one range of a source's queue: so many, or this part of all.
LEAST_RANGE, RANGE_PART = 1000, 10_000
#: Sources up to this number (about 50 bytes each) are sent to every task; more are joined by a shuffle, hot ones dealt.
MOST_SENT = 100_000
_SEPARATORS = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in their order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    #: No document is taken, and no source aimed at, more than so many times.
    most_times: int = 3


def size_of(text: Column) -> Column:
    """The number of words, without a list of them: every word and what separates it from the next becomes one letter."""
    begun = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{_SEPARATORS}]++", "")
    return F.length(F.regexp_replace(begun, f"[^{_SEPARATORS}]++[{_SEPARATORS}]*+", "x")).cast("long")


def running(df: DataFrame, order: list[str], amounts: dict[str, str], label: str) -> DataFrame:
    """``df`` with, for every (name: column) of ``amounts``, the column's sum over all rows before in ``order``.

    Rows are dealt to ranges of ``order``, which must be a total one, and kept; one row a range is summed across ranges.
    """
    kept = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    parts = kept.groupBy("__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in amounts.items()))
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{n}").over(across), F.lit(0)).alias(f"__{n}") for n in amounts))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in amounts.items()))
    return summed.join(parts, "__part").select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in amounts))


def groups(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size and how many rows agree in them."""
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    return written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-groups")


def targets(grouped: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """rank, source, none, source_size, target, blocks and ranges of every source, and the budget."""
    of = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.ceil(F.col("rows") / BLOCK)).alias("blocks"))
    of = of.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = running(of, ["none", "source"], {"rank": "one"}, "mix-ranks")
    weights = F.array(*(F.lit(w) for w in s.weights))
    weighed = ranked.withColumn("weight", F.get(weights, F.pmod("rank", F.lit(len(s.weights))).cast("int")).cast("long"))
    weighed = weighed.withColumn("bound", F.col("source_size") * s.most_times).withColumn("ratio", F.col("bound").cast("double") / F.col("weight"))
    levels = written(running(weighed, ["ratio", "rank"], {"bounds": "bound", "weights": "weight"}, "mix-levels"), "mix-sources")
    budget, weight, blocks = levels.agg(F.sum("source_size"), F.sum("weight"), F.sum("blocks")).first()
    budget, weight = budget or 0, weight or 0
    # A source is at its bound if the level that fills it is within the budget.
    bounded = F.col("bounds").cast("double") + F.col("ratio") * (F.lit(weight) - F.col("weights")) <= F.lit(budget).cast("double")
    left, over = levels.where(~bounded).agg(F.sum("weight"), F.sum("bound")).first()
    held = levels.where(bounded).agg(F.sum("bound")).first()[0] or 0
    level = (budget - held) / left if left else 0.0
    aim = F.when(bounded, F.col("bound").cast("double")).otherwise(F.least(F.col("bound").cast("double"), F.lit(float(level)) * F.col("weight")))
    long_range = max(LEAST_RANGE, (blocks or 0) // RANGE_PART)
    return levels.select("rank", "source", "none", "source_size", aim.alias("target"), "blocks", F.ceil(F.col("blocks") / long_range).alias("ranges")), budget


def queued(docs: DataFrame, doc_id: str, text: str, source: str, s: Settings) -> tuple[DataFrame, int]:
    """Blocks of rows with ``before``, what stands before them in their source's shuffled queue; and the budget."""
    grouped = groups(docs, doc_id, text, source)
    sources, budget = targets(grouped, s)
    blocks = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.withColumn("rows", F.least(F.col("rows") - F.col("block"), F.lit(BLOCK)))
    # A source of null is joined as a value of its own.
    blocks = blocks.withColumn("none", F.col("source").isNull()).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    named = sources.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    small = sources.count() <= MOST_SENT
    met = blocks.join(F.broadcast(named), ["none", "source"]) if small else spread(blocks, named, ["none", "source"], size="blocks")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # The hash's first 32 bits give its range among the source's; ranges stand as the hashes do.
    bits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    met = met.withColumn("key", key).withColumn("range", F.shiftright(bits * F.col("ranges"), 32))
    met = met.select("rank", "range", "key", "doc_id", "size", "block", "rows", "source_size", "target", (F.col("size") * F.col("rows")).alias("amount"))
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size", "block")
    summed = written(met.withColumn("inside", F.sum("amount").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("amount")), "mix-queue")
    across = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = summed.groupBy("rank", "range").agg(F.sum("amount").alias("amount")).select("rank", "range", F.coalesce(F.sum("amount").over(across), F.lit(0)).alias("offset"))
    placed = summed.drop("amount").join(offsets, ["rank", "range"]).withColumn("before", F.col("inside") + F.col("offset"))
    return placed.select("rank", "doc_id", "size", "rows", "source_size", "target", "before"), budget


def finish(end: Column) -> Column:
    """Virtual finish time of the copy that ends at ``end`` of its source's queue."""
    return end.cast("double") / F.col("target")


def copies(blocks: DataFrame, s: Settings) -> DataFrame:
    """Every copy that may be taken: rank, doc_id, size, epoch (from 0), end of its place in the queue, finish."""
    rows = blocks.where("size > 0 and target > 0").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(s.most_times - 1))))
    end = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("row") * F.col("size")
    return each.withColumn("end", end).select("rank", "doc_id", "size", "epoch", "end", finish(F.col("end")).alias("finish"))


def sorted_copies(blocks: DataFrame, budget: int, s: Settings) -> tuple[DataFrame, tuple | None]:
    """All copies, range-sorted and kept (``part``: their range), and finish, rank and end of the last within the budget."""
    order = ["finish", "rank", "end"]
    kept = written(copies(blocks, s).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-copies")
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # over one row a range
    parts = kept.groupBy("part").agg(F.sum("size").alias("amount"), F.max(F.struct(*order)).alias("last")).withColumn("so_far", F.sum("amount").over(so_far))
    inside = parts.where(F.col("so_far") <= budget).agg(F.max(F.struct("part", "last"))).first()[0]
    ends = parts.where(F.col("so_far") > budget).agg(F.min(F.struct("part", F.col("so_far") - F.col("amount")))).first()[0]
    cut = tuple(inside[1]) if inside else None
    if ends:
        up_to = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over the one range where the budget ends
        tail = kept.where(F.col("part") == ends[0]).withColumn("so_far", F.lit(ends[1]) + F.sum("size").over(up_to)).where(F.col("so_far") <= budget)
        last = tail.agg(F.max(F.struct(*order))).first()[0]
        cut = tuple(last) if last else cut
    return kept, cut


def taken_by(cut: tuple | None, finish: Column, end: Column) -> Column:
    if cut is None:
        return F.lit(False)
    return F.struct(finish.alias("f"), F.col("rank").alias("r"), end.alias("e")) <= F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).cast("long").alias("r"), F.lit(cut[2]).cast("long").alias("e"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", settings: Settings = Settings()) -> DataFrame:
    """The mix itself: doc_id, epoch, size and finish of every copy that is taken; finish, rank, end order it."""
    blocks, budget = queued(docs, doc_id, text, source, settings)
    kept, cut = sorted_copies(blocks, budget, settings)
    return kept.where(taken_by(cut, F.col("finish"), F.col("end"))).select(F.col("doc_id").alias(doc_id), "epoch", "size", "finish", "rank", "end")


def shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it) of every row."""
    blocks, budget = queued(docs, doc_id, text, source, settings)
    blocks = written(blocks, "mix-blocks")
    _, cut = sorted_copies(blocks, budget, settings)
    rows = blocks.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    end = lambda epoch: F.col("source_size") * epoch + F.col("before") + F.col("row") * F.col("size")
    times = sum((F.when(taken_by(cut, finish(end(e)), end(e)), 1).otherwise(0) for e in range(settings.most_times)), F.lit(0).cast("long"))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * times).otherwise(0)
    return rows.select(F.col("doc_id").alias(doc_id), "size", "source_size", "target", taken.cast("long").alias("taken"))


def oracle() -> str:
    """The same over the table documents, in DuckDB's SQL: one window for each queue, and one for the mix."""
    return r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bounds,
    sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    sum(source_size) OVER () AS budget
  FROM sources),
bounded AS (SELECT *, CAST(bounds AS DOUBLE) + ratio * weights <= budget AS full_up FROM levels),
level AS (
  SELECT (any_value(budget) - coalesce(sum(3 * source_size) FILTER (full_up), 0))::DOUBLE / (sum(weight) FILTER (NOT full_up))::DOUBLE AS level FROM bounded),
targets AS (
  SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, budget,
    CASE WHEN full_up THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, level * weight) END AS target
  FROM bounded, level),
queues AS (
  SELECT r, d.doc_id, d.size, t.rank, t.source_size, t.target, t.budget,
    sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size, r) AS done
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT r, size, rank, budget, CAST(done + epoch * source_size AS DOUBLE) / target AS finish, done + epoch * source_size AS "end"
  FROM queues, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
mix AS (SELECT r, size, budget, sum(size) OVER (ORDER BY finish, rank, "end" ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
taken AS (SELECT r, sum(size) AS taken FROM mix WHERE so_far <= budget GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queues LEFT JOIN taken USING (r)"""
