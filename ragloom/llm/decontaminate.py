"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A text becomes its lower-case runs of letters and digits.  A seed is a fixed mask over
consecutive tokens that reads some places and ignores others, so a substituted token
at an ignored place changes nothing; the hash of what a mask reads, at every place, is
joined between benchmark items and documents.  A hit proposes a diagonal (place in the
document less place in the item).  On it the item's tokens are compared with the
document's, and the pair counts as an overlap if some ``window`` consecutive item
tokens (the whole item, if shorter) hold at least ``matches`` equal ones in proportion.
Equal seeds of one item and one document meet once with all their places, so a text that
repeats itself proposes each diagonal once; and all windows of a diagonal are judged in
one pass over its unequal places.

An item too short for the fixed masks to hit all its overlaps (under nine tokens) has
masks of its own length instead, one for every choice of the places that have to be
equal, joined with the documents' runs of that length.

Hits are kept as a table in the shared folder, one row a document and item.  They are few
beside the texts, so only texts with a hit are read again, cut to tokens once more and
verified; the others are not shuffled.  Where hits are too many to be sent to every task,
texts are joined with them once, by row, and rows that repeat are dealt over tasks.  Items with equal tokens are looked for once and all reported.

Items or documents that are null or without a token overlap with nothing; an item of one
token overlaps with every document that holds it.  A pair of ids gives one row: where an
id is repeated, with the same text or with others, the pair of texts with the most equal
tokens counts, and of these that with the most diagonals.  Rows without an id are found
under null.  Empty tables give no rows, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.support import spread, written

#: Distinct seeds of the benchmark up to this number (about 16 bytes each) are sent to every task, and as many hits; more are joined by a shuffle.
MOST_SENT = 500_000
#: A text repeats itself where it has so many pairs of places with equal seeds to a diagonal; diagonals verified at once.
REPETITIVE, DIAGONALS = 4, 256


@dataclass(frozen=True)
class Settings:
    #: Fixed masks; 1 reads a token, 0 ignores it.  Each begins and ends with 1.  Together they hit every overlap with
    #: an item of nine or more tokens, wherever its unequal tokens stand.
    masks: tuple[str, ...] = ("110110101", "111001011", "10101111")
    #: An overlap has window consecutive tokens of the item of which at least ``matches`` equal the document's.
    window: int = 13
    matches: int = 11


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits of the lower-case text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def hashed(words: Column) -> Column:
    """The tokens' hashes, so that a seed is of numbers and a token's letters are read once."""
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, s: Settings) -> Column:
    """Array of (place, hash) of every mask at every place; ``words``: tokens, or what stands for them."""

    def of(k: int, mask: str) -> Column:
        reads = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(words) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(p.alias("place"), F.xxhash64(F.lit(k), *[F.get(words, p + i) for i in reads]).alias("seed")))

    return F.concat(*(of(k, mask) for k, mask in enumerate(s.masks)))


def needed(n: int, s: Settings) -> int:
    """Equal tokens that make an overlap with ``n`` consecutive tokens."""
    return -(-n * s.matches // s.window)


@lru_cache
def covered(n: int, s: Settings) -> bool:
    """The fixed masks hit every overlap with ``n`` tokens, wherever the unequal ones stand."""
    reads = [{p + i for i, c in enumerate(mask) if c == "1"} for mask in s.masks for p in range(n - len(mask) + 1)]
    return all(any(r.isdisjoint(unequal) for r in reads) for unequal in combinations(range(n), n - needed(n, s)))


def run_seeds(words: Column, n: int, s: Settings) -> Column:
    """Array of (place, run, hash) of every run of ``n`` tokens by every choice of those that have to be equal.

    Runs begin before and end behind the text by as many tokens as may be unequal; there they hold empty tokens.
    """
    spare = n - needed(n, s)
    beyond = F.array_repeat(F.lit(""), spare)
    padded = F.concat(beyond, words, beyond)
    last = F.size(words) + 2 * spare - n
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def of(k: int, reads: Sequence[int]) -> Column:
        return F.transform(places, lambda p: F.struct((p - spare).alias("place"), F.slice(padded, p + 1, F.lit(n)).alias("run"), F.xxhash64(F.lit(n), F.lit(k), *[F.get(padded, p + i) for i in reads]).alias("seed")))

    return F.concat(*(of(k, reads) for k, reads in enumerate(combinations(range(n), n - spare))))


def short_pairs(words: DataFrame, own: DataFrame, lengths: list[int], s: Settings) -> DataFrame:
    """row, doc, item, n_matched and n_diagonals of the overlaps of the items of these lengths."""
    runs = lambda name: F.explode(F.concat(*(run_seeds(F.col(name), n, s) for n in lengths))).alias("s")
    item_seeds = own.select("item", "item_words", runs("item_words")).where(F.col("s.run") == F.col("item_words")).select("item", "item_words", F.col("s.seed").alias("seed"))
    doc_seeds = words.select("row", "doc", runs("doc_words")).select("row", "doc", F.col("s.place").alias("diagonal"), F.col("s.run").alias("beside"), F.col("s.seed").alias("seed"))
    hits = doc_seeds.join(F.broadcast(item_seeds) if item_seeds.count() <= MOST_SENT else item_seeds, "seed")
    matched = F.size(F.filter(F.zip_with("item_words", "beside", lambda w, d: w == d), lambda same: same))
    needs = F.element_at(F.create_map(*[F.lit(x) for n in lengths for x in (n, needed(n, s))]), F.size("item_words"))
    kept = hits.select("row", "doc", "item", "diagonal", matched.alias("matched"), needs.alias("needs")).where("matched >= needs")
    return kept.groupBy("row", "doc", "item").agg(F.max("matched").alias("n_matched"), F.countDistinct("diagonal").alias("n_diagonals"))


def met_items(doc_seeds: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """row, item, low, high and diagonals of every document and item that share a seed.

    Seeds meet as (row, item, seed) with the places of each, not place by place.  Where a text repeats itself, so that
    pairs of places outnumber the diagonals that they can lie on, all diagonals from ``low`` to ``high`` count as hit
    (``diagonals`` is null): the masks hit every overlap, so verifying more diagonals finds nothing else.
    """
    of_items = item_seeds.groupBy("seed", "item").agg(F.collect_set("item_place").alias("item_places"))
    pairs = of_items.select("seed", "item")
    if pairs.count() <= MOST_SENT:
        met = doc_seeds.join(F.broadcast(pairs), "seed")
    else:
        # A seed of many documents is dealt over tasks; its items are one row.
        met = spread(doc_seeds, pairs.groupBy("seed").agg(F.collect_set("item").alias("items")), ["seed"]).select("row", "place", "seed", F.explode("items").alias("item"))
    places = met.groupBy("row", "item", "seed").agg(F.collect_set("place").alias("doc_places")).join(of_items, ["item", "seed"])
    n_pairs = F.size("doc_places").cast("long") * F.size("item_places")
    low, high = F.array_min("doc_places") - F.array_max("item_places"), F.array_max("doc_places") - F.array_min("item_places")
    found = places.groupBy("row", "item").agg(F.sum(n_pairs).alias("n_pairs"), F.min(low).alias("low"), F.max(high).alias("high"), F.collect_list(F.struct("doc_places", "item_places")).alias("places"))
    differences = F.flatten(F.transform("places", lambda s: F.flatten(F.transform(s["doc_places"], lambda d: F.transform(s["item_places"], lambda i: d - i)))))
    few = F.col("n_pairs") <= REPETITIVE * (F.col("high") - F.col("low") + 1)
    return found.select("row", "item", "low", "high", F.when(few, F.array_distinct(differences)).alias("diagonals"))


def near_diagonals(words: Column, item: Column, diagonals: Column, s: Settings) -> Column:
    """Equal tokens of every diagonal with an overlap.

    A window of tokens has enough equal ones if so few unequal places lie within it that those before and behind
    stand more than its length apart; so one pass over the unequal places does for all windows.  Places of the item
    beyond the document's ends are unequal.  Stretches that are equal as a whole are not looked at token by token.
    """
    n, whole = F.size(item), F.size(words)
    length = F.least(n, F.lit(s.window))
    spare = length - F.ceil(length * s.matches / s.window).cast("int")

    # Step by step, so that what a later step reads twice is made once.
    def cut(a: Column) -> Column:
        low, high = F.greatest(F.lit(0), -a), F.least(n, whole - a)  # places of the item that lie in the document
        return F.struct(low.alias("low"), high.alias("high"), F.slice(item, low + 1, high - low).alias("own"), F.slice(words, low + a + 1, high - low).alias("beside"))

    def compared(d: Column) -> Column:
        places = F.filter(F.transform(F.zip_with(d["own"], d["beside"], lambda x, y: x == y), lambda same, i: F.when(~same, i + d["low"])), lambda p: p.isNotNull())
        return F.struct(d["low"].alias("low"), d["high"].alias("high"), F.when(d["own"] == d["beside"], F.array().cast("array<int>")).otherwise(places).alias("unequal"))

    def edged(d: Column) -> Column:
        low, high = d["low"], d["high"]
        edges = F.concat(F.sequence(F.greatest(F.lit(-1), low - 1 - spare), low - 1), d["unequal"], F.sequence(high, F.least(n, high + spare)))
        return F.struct((high - low - F.size(d["unequal"])).alias("matched"), edges.alias("edges"))

    def near(d: Column) -> Column:
        e = d["edges"]
        wide = F.exists(F.sequence(F.lit(0), F.size(e) - spare - 2), lambda j: F.get(e, j + spare + 1) - F.get(e, j) > length)
        return F.when(F.size(e) < spare + 2, True).otherwise(wide)

    inside = F.filter(diagonals, lambda a: (a > -n) & (a < whole))
    each = F.transform(F.transform(F.transform(inside, cut), compared), edged)
    return F.transform(F.filter(each, near), lambda d: d["matched"])


def verified(texts: DataFrame, hits: DataFrame, own: DataFrame, s: Settings) -> DataFrame:
    """row, doc, item, n_matched and n_diagonals of the pairs among ``hits`` that overlap.

    Every text is joined, and cut to tokens, once.  Pairs with more than DIAGONALS diagonals, as of texts that repeat
    themselves, are verified so many at a time, each time with the stretch of the text that they need, and dealt over tasks.
    """
    hits = hits.withColumn("many", F.when(F.col("diagonals").isNull(), F.col("high") - F.col("low") + 1).otherwise(F.size("diagonals")) > DIAGONALS)
    longest = own.agg(F.max(F.size("item_words"))).first()[0] or 0

    def of(part: DataFrame) -> DataFrame:
        by_row = part.join(own, "item").groupBy("row").agg(F.collect_list(F.struct("item", "item_words", "low", "high", "diagonals")).alias("found"))
        n, held = part.agg(F.count("*"), F.sum(F.greatest(F.size("diagonals"), F.lit(0)))).first()
        sent = n <= MOST_SENT and (held or 0) <= 8 * MOST_SENT and longest * n <= 64 * MOST_SENT
        rows = texts.join(F.broadcast(by_row), "row") if sent else spread(texts, by_row, ["row"])
        cut = rows.select("row", "doc", F.explode(F.array(tokens(F.col("doc_text")))).alias("doc_words"), "found").select("row", "doc", "doc_words", F.explode("found").alias("f"))
        return cut.select("row", "doc", "doc_words", "f.item", "f.item_words", F.coalesce(F.col("f.diagonals"), F.sequence("f.low", "f.high")).alias("of"))

    pairs = of(hits.where("not many")).withColumn("at", F.lit(0))
    if hits.where("many").first():
        blocks = of(hits.where("many")).withColumn("of", F.array_sort("of")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("of") - 1, F.lit(DIAGONALS))))
        blocks = blocks.withColumn("of", F.slice("of", F.col("at") + 1, F.lit(DIAGONALS))).withColumn("from", F.greatest(F.lit(0), F.get("of", F.lit(0))))
        stretch = F.slice("doc_words", F.col("from") + 1, F.greatest(F.lit(0), F.element_at("of", -1) + F.size("item_words") - F.col("from")))
        blocks = blocks.select("row", "doc", stretch.alias("doc_words"), "item", "item_words", F.transform("of", lambda a: a - F.col("from")).alias("of"), "at")
        # Few bytes but much work: a number of partitions, which adaptive execution would else make one.
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.unionByName(blocks.repartition(parts, "row", "item", "at"))
    near = pairs.select("row", "doc", "item", "at", F.explode(F.array(near_diagonals(F.col("doc_words"), F.col("item_words"), F.col("of"), s))).alias("near")).where(F.size("near") > 0)
    once = near.groupBy("row", "doc", "item", "at").agg(F.max("near").alias("near"))  # rows that repeat others find the same
    return once.groupBy("row", "doc", "item").agg(F.max(F.array_max("near")).alias("n_matched"), F.sum(F.size("near").cast("long")).alias("n_diagonals"))


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, n_diagonals and n_matched (most equal tokens on one diagonal) of every overlapping pair."""
    s = settings
    if not covered(s.window, s):
        raise ValueError("the masks don't hit every overlap")
    named = items.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).withColumn("key", F.md5(F.array_join("item_words", " ").cast("binary")))
    # Numbered once and kept, so that every job sees the same numbers.
    every = written(named.dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("item"), "key", "item_words"), "items")
    lengths = sorted(r[0] for r in every.select(F.size("item_words").alias("n")).where(F.col("n") < s.window).distinct().collect() if not covered(r[0], s))
    own = every.where(~F.size("item_words").isin(lengths)).select("item", "item_words")
    item_seeds = own.select("item", hashed(F.col("item_words")).alias("hashes")).select("item", F.explode(seeds(F.col("hashes"), s)).alias("s")).select("item", F.col("s.place").alias("item_place"), F.col("s.seed").alias("seed"))
    # A row goes by a hash of its id and text; what the hits of two rows have in common is told apart by the verification.
    # Exploded, so that the hash is taken once a row and not once a seed.
    texts = docs.select(F.explode(F.array(F.xxhash64(F.col(doc_id).cast("string"), doc_text))).alias("row"), F.col(doc_id).alias("doc"), F.col(doc_text).alias("doc_text"))
    words = texts.select("row", "doc", tokens(F.col("doc_text")).alias("doc_words"))
    doc_seeds = words.select("row", hashed(F.col("doc_words")).alias("hashes")).select("row", F.explode(seeds(F.col("hashes"), s)).alias("s")).select("row", F.col("s.place").alias("place"), F.col("s.seed").alias("seed"))
    hits = written(met_items(doc_seeds, item_seeds), "hits")
    of_rows = verified(texts, hits, own, s)
    if lengths:
        of_rows = of_rows.unionByName(short_pairs(words, every.where(F.size("item_words").isin(lengths)), lengths, s))
    ids = every.join(named.select("item_id", "key").distinct(), "key").select("item", "item_id")
    pairs = of_rows.join(ids, "item").groupBy("doc", "item_id").agg(F.max(F.struct("n_matched", "n_diagonals")).alias("most"))
    return pairs.select(F.col("doc").alias(doc_id), F.col("item_id").alias(item_id), F.col("most.n_diagonals").alias("n_diagonals"), F.col("most.n_matched").alias("n_matched"))


def without_overlaps(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, unchanged.  Rows with equal texts fare alike, so ids don't matter."""
    key = F.md5(F.coalesce(F.col(doc_text), F.lit("")).cast("binary"))
    named = items.select(F.monotonically_increasing_id().alias("item_id"), F.col(item_text).alias("text"))
    found = overlaps(docs.select(key.alias("key"), F.col(doc_text).alias("text")), named, "key", settings=settings).select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").drop("__key")


def oracle(settings: Settings = Settings()) -> str:
    """The same over the tables documents and benchmark, in DuckDB's SQL, with the seeds spelled out instead of hashed."""
    s = settings
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda t: t <> '')"
    key = lambda mask: " || chr(1) || ".join(f"words[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
    seed = lambda table, id: " UNION ALL ".join(f"SELECT {id}, p, '{k}' || {key(m)} AS seed FROM (SELECT {id}, words, unnest(range(0, len(words) - {len(m) - 1})) AS p FROM {table})" for k, m in enumerate(s.masks))
    return f"""
WITH docs AS (SELECT doc_id, {split} AS words FROM documents),
items AS (SELECT item_id, words FROM (SELECT item_id, {split} AS words FROM benchmark) WHERE len(words) >= {min(map(len, s.masks))}),
doc_seeds AS ({seed("docs", "doc_id")}),
item_seeds AS ({seed("items", "item_id")}),
hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.p - i.p AS diagonal FROM doc_seeds d JOIN item_seeds i USING (seed)),
places AS (
  SELECT h.doc_id, h.item_id, h.diagonal, i.words AS iw, d.words AS dw, unnest(range(0, len(i.words))) AS k
  FROM hits h JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
flags AS (
  SELECT doc_id, item_id, diagonal, k, len(iw) AS n,
    CASE WHEN diagonal + k >= 0 AND diagonal + k < len(dw) AND dw[diagonal + k + 1] = iw[k + 1] THEN 1 ELSE 0 END AS equal
  FROM places),
runs AS (
  SELECT *, sum(equal) OVER w AS near, count(*) OVER w AS seen, sum(equal) OVER (PARTITION BY doc_id, item_id, diagonal) AS matched
  FROM flags WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY k ROWS BETWEEN {s.window - 1} PRECEDING AND CURRENT ROW))
SELECT doc_id, item_id, count(DISTINCT diagonal) AS n_diagonals, CAST(max(matched) AS BIGINT) AS n_matched
FROM runs
WHERE seen = least(n, {s.window}) AND near >= ceil(least(n, {s.window}) * {s.matches} / {s.window}.0)
GROUP BY doc_id, item_id"""
