"""Substring deduplication by relative Lempel-Ziv parsing.

The words of every document are reference material.  An index samples them: of the
grams (6 words) within each window of 35 words, the one with the least hash is an
anchor, so windows with equal words hold equal anchors at equal places.  For each gram
that is an anchor more than once, one occurrence is elected as its reference block, by a
rank of documents, so that the anchors of a shared passage elect the same document.

Every document is then factored.  Around each of its repeated anchors it is matched,
window by window, with the block at that alignment; what fits is extended over the next
anchors as long as block document and alignment stay the same, which gives maximal factors
(block, offset, length).  Those of a window's length or more count.  What remains are
windows around repeated anchors where the text leaves the block that it was matched with.
These boundary windows are looked up in a second index, of whole windows, in which each
repeated one elects a block in the same way; so every indexed block is tried, and their
factors join the others.  From all of them the document is parsed greedily, always by the
factor that reaches farthest.  A factor marks the words of the text and of its block.

Every window has exactly one anchor, so the marked words are exactly those covered by a
window whose word sequence starts anywhere else.  Words are compared by 64-bit hashes
of 6-word grams and of whole windows together.  Grams, windows and rows that stand there
very often are dealt over tasks.

Null or empty text: no words, nothing removed.  A row repeated with its id removes all
windows of both, as each starts elsewhere; it is parsed once.  Texts shorter than a window
stay whole.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import mix, narrow, ragged, run_hashes, spread, steps, utf8, words, written

WINDOW = 35
GRAM = 6
#: Occurrences of a gram or a window in one group, about.
GROUP = 2048
#: A place in the reference is one number: a rank of its document, and in the last 24 bits the word.
PLACES = 1 << 24


def least_grams(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each place the place of the least of the next ``reach`` grams, the leftmost of equals."""
    order = mix(grams)
    n = len(order) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = order, np.arange(len(order)), 1
    while size < reach:
        step = min(size, reach - size)
        left, right = slice(0, len(best) - step), slice(step, None)
        later = best[right] < best[left]
        best, at = np.where(later, best[right], best[left]), np.where(later, at[right], at[left])
        size += step
    return at[:n]


class Parsed:
    """Words of one step of rows: their windows, and the anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.first, hashes = words(data, offsets)
        self.grams = run_hashes(hashes, gram)
        self.windows = run_hashes(hashes, window)
        self.anchor = least_grams(self.grams, window - gram + 1)
        self.window = window

    def row(self, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """First word, anchors (places of grams, in the step), and first and last window of each anchor."""
        low, high = self.first[i], self.first[i + 1] - self.window + 1
        if high <= low:
            none = np.zeros(0, np.int64)
            return low, none, none, none
        own = self.anchor[low:high]
        cuts = np.flatnonzero(np.diff(own)) + 1
        begin = np.r_[0, cuts]
        end = np.r_[cuts, len(own)] - 1
        return low, own[begin], low + begin, low + end


def keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    """id, text, and a key of 128 bits that rows share only if both are equal."""
    own = [F.col(id).cast("string"), F.coalesce(F.col(text), F.lit(""))]
    return df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(1), *own).alias("k2"))


def rank(place: str) -> Column:
    """Of a word of the document ``k1``; the next word has the next number."""
    return F.xxhash64("k1").bitwiseAND(F.lit(-PLACES)) + F.col(place) % PLACES


def anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, k1, place) of every anchor; ``place`` counts words of the row."""
    schema = "gram long, k1 long, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            keys = batch.column(1).to_numpy()
            for first, last in steps(np.diff(offsets)):
                own = offsets[first : last + 1]
                p = Parsed(data[own[0] : own[-1]], own - own[0], window, gram)
                found = [(k, *p.row(k)[:2]) for k in range(last - first)]
                at = np.concatenate([f[2] for f in found])
                base = np.concatenate([np.full(len(f[2]), f[1]) for f in found])
                key = np.concatenate([np.full(len(f[2]), keys[first + f[0]]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(p.grams[at].view(np.int64)), pa.array(key, pa.int64()), pa.array((at - base).astype(np.int32))], names=["gram", "k1", "place"])

    return rows.select("text", "k1").mapInArrow(run, schema)


def occurrences(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """For each repeated anchor of a row the hashes of its windows.

    ``rows``: text, k1, k2 and the list anchors of (place, own rank, block's rank, n).  Gives gram, k1, k2, the first
    window's place, how many words the anchor lies behind it, align (what added to a place of the row gives the rank of
    the block's place), whether the row is the block, n, and the hashes.  For a row that follows an equal one it only
    gives its last window's place, without a gram: all its windows are duplicates.
    """
    schema = "gram long, k1 long, k2 long, start int, back int, align long, elected boolean, n long, windows array<long>"
    names = ["gram", "k1", "k2", "start", "back", "align", "elected", "n", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = None, None
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            place, mine, block, count = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for first, last in steps(np.diff(offsets)):
                own = offsets[first : last + 1]
                p = Parsed(data[own[0] : own[-1]], own - own[0], window, gram)
                out: list[list[np.ndarray]] = [[] for _ in range(9)]
                sizes = []
                again = []
                for k in range(last - first):
                    r = first + k
                    low, at, begin, end = p.row(k)
                    if (k1[r], k2[r]) == seen:
                        if told != seen and len(end):
                            again.append((int(k1[r]), int(k2[r]), int(end[-1] - low)))
                            told = seen
                        continue
                    seen = (k1[r], k2[r])
                    listed = slice(bounds[r], bounds[r + 1])
                    order = np.argsort(place[listed], kind="stable")
                    known = place[listed][order]
                    spot = np.minimum(np.searchsorted(known, at - low), len(known) - 1)
                    hit = known[spot] == at - low
                    if not hit.any():
                        continue
                    spot = order[spot[hit]]
                    at, begin, end = at[hit], begin[hit], end[hit]
                    size = end - begin + 1
                    sizes.append(size)
                    take = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    full = lambda v: np.full(len(at), v)  # noqa: B023, E731
                    lead = block[listed][spot]
                    for c, v in zip(out, (p.grams[at].view(np.int64), full(k1[r]), full(k2[r]), begin - low, at - begin, lead - (at - low), mine[listed][spot] == lead, count[listed][spot], p.windows[take].view(np.int64))):
                        c.append(v)
                if sizes:
                    c = [np.concatenate(x) for x in out]
                    ends = np.r_[0, np.cumsum(np.concatenate(sizes))]
                    yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2]), pa.array(c[3].astype(np.int32)), pa.array(c[4].astype(np.int32)), pa.array(c[5]), pa.array(c[6].astype(bool)), pa.array(c[7]), ragged(c[8], ends, pa.int64())], names=names)
                if again:
                    x, y, z = zip(*again)
                    none = lambda kind: pa.nulls(len(again), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.int32()), none(pa.int32()), none(pa.int64()), pa.array([False] * len(again)), pa.array([1] * len(again), pa.int64()), none(pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(run, schema)


def factored(parsed: DataFrame) -> DataFrame:
    """Match each occurrence with the block that leads its group.

    ``parsed``: occurrences(), grouped by gram and salt within partitions, the elected first.  Gives runs of
    windows (first and last place in their row): with align the factors of a row, without it what is marked for
    others' sake (the blocks of these, and rows that follow an equal one); and each boundary window, with its hash.
    """
    schema = "k1 long, k2 long, first int, last int, align long, hash long"
    names = ["k1", "k2", "first", "last", "align", "hash"]

    def batch_of(k1: np.ndarray, k2: np.ndarray, first: np.ndarray, last: np.ndarray, align: pa.Array, hashes: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), align, hashes], names=names)

    def matched(t: pa.RecordBatch, head: np.ndarray) -> pa.RecordBatch:
        """``head``: for each row the row of its block."""
        k1, k2, start, back = (t.column(i).to_numpy() for i in range(4))
        align = t.column(7).to_numpy()
        ends = t.column(4).offsets.to_numpy()
        windows = t.column(4).values.to_numpy()
        lead = head == np.arange(len(head))
        size = np.where(lead, 0, np.diff(ends))
        row = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        block = head[row]
        # Window k starts back - k words before the anchor, and so does this window of the block.
        other = k - back[row] + back[block]
        inside = (other >= 0) & (other < np.diff(ends)[block])
        own = windows[ends[row] + k]
        hit = inside & (own == windows[ends[block] + np.where(inside, other, 0)])
        edge = np.r_[True, (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])][: len(row)]
        begin = np.flatnonzero(edge)
        stop = np.r_[begin[1:], len(row)][: len(begin)] - 1
        begin, stop = begin[hit[begin]], stop[hit[begin]]
        left = np.flatnonzero(~hit)
        length = stop - begin
        # Runs of one block that are the same are marked once.
        source = np.unique(np.stack([block[begin], start[block[begin]] + other[begin], length]), axis=1)
        first = np.concatenate([start[row[begin]] + k[begin], source[1], start[row[left]] + k[left]])
        last = first + np.concatenate([length, source[2], np.zeros(len(left), np.int64)])
        who = np.concatenate([row[begin], source[0], row[left]])
        n_source, n_left = source.shape[1], len(left)
        return batch_of(k1[who], k2[who], first, last, pa.concat_arrays([pa.array(align[row[begin]]), pa.nulls(n_source + n_left, pa.int64())]), pa.concat_arrays([pa.nulls(len(begin) + n_source, pa.int64()), pa.array(own[left])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the block of the group that the last batch ended in
        for batch in batches:
            whole = batch.column(5).is_null()
            if whole.true_count:
                rows = batch.filter(whole)
                last = rows.column(2).to_numpy()
                yield batch_of(rows.column(0).to_numpy(), rows.column(1).to_numpy(), np.zeros(len(last), np.int32), last, pa.nulls(len(last), pa.int64()), pa.nulls(len(last), pa.int64()))
                batch = batch.filter(pc.invert(whole))
            if not batch.num_rows:
                continue
            t = batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            gram, salt = t.column(5).to_numpy(), t.column(6).to_numpy()
            new = np.r_[True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            yield matched(t, head)
            carried = t.slice(int(head[-1]), 1)

    return parsed.select("k1", "k2", "start", "back", "windows", "gram", "salt", "align").mapInArrow(run, schema)


def duplicate_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, spans): for each k1 that holds duplicates the windows that start elsewhere too, as (k2, first, last, align).

    ``rows``: keyed().
    """
    index = anchors(rows, window, gram)
    repeated = written(index.groupBy("gram").agg(F.count("*").alias("n"), F.min(rank("place")).alias("block")).where("n > 1"), "grams")
    shared = spread(index, repeated, ["gram"], "n", GROUP).select("k1", F.struct("place", rank("place").alias("own"), "block", "n").alias("anchor"))
    of_row = shared.groupBy("k1").agg(F.collect_set("anchor").alias("anchors"))
    met = rows.join(of_row, "k1").sortWithinPartitions("k1")
    parsed = occurrences(met.select("text", "k1", "k2", "anchors", "id"), window, gram)
    # A gram of many occurrences is dealt to several groups; the block goes to each.
    salts = F.ceil(F.col("n") / GROUP).cast("int")
    salt = F.when(F.col("elected"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("k1", "start"), salts).cast("int")))
    dealt = parsed.withColumn("salt", F.explode(salt)).repartition("gram", "salt").sortWithinPartitions("gram", "salt", F.desc("elected"))
    runs = written(factored(dealt), "runs")
    # Boundary windows, by the index of whole windows.
    left = runs.where("hash is not null").select("hash", "k1", "k2", "first")
    elected = written(left.groupBy("hash").agg(F.count("*").alias("n"), F.min(rank("first")).alias("block")).where("n > 1"), "windows")
    align = F.when(rank("first") != F.col("block"), F.col("block") - F.col("first"))
    found = spread(left, elected, ["hash"], "n", GROUP).select("k1", "k2", "first", F.col("first").alias("last"), align.alias("align"))
    spans = runs.where("hash is null").select("k1", "k2", "first", "last", "align").union(found)
    return spans.groupBy("k1").agg(F.collect_set(F.struct("k2", "first", "last", "align")).alias("spans"))


def extended(first: np.ndarray, last: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one alignment that touch become one."""
    order = np.lexsort((first, align))
    first, last, align = first[order], last[order], align[order]
    new = np.r_[True, (align[1:] != align[:-1]) | (first[1:] > last[:-1] + 1)][: len(first)]  # runs of one alignment don't contain one another
    begin = np.flatnonzero(new)
    return first[begin], np.maximum.reduceat(last, begin) if len(begin) else last, align[begin]


def greedy(first: np.ndarray, end: np.ndarray, align: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, words, align) of the parse: at each word the factor that reaches farthest; the words between stand for themselves."""
    out: list[tuple[int, int, int]] = []
    at, k = 0, 0
    best, by = 0, 0  # how far the factors that began reach, and which does
    order = np.argsort(first, kind="stable")
    while k < len(order) or best > at:
        if best <= at:
            at = max(at, int(first[order[k]]))
        while k < len(order) and first[order[k]] <= at:
            if end[order[k]] > best:
                best, by = int(end[order[k]]), int(align[order[k]])
            k += 1
        if best > at:
            out.append((at, best - at, by))
            at = best
    return out


def remove_duplicate_passages(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space) and factors of every row of ``df``.

    ``factors``: the copies in the greedy parse, as first word, number of words, block (a rank of its document) and
    offset (the block's word, modulo PLACES).  A document that others copy has no factor for what they take from it.
    """
    rows = keyed(df, id, text)
    joined = rows.join(duplicate_windows(rows, window, gram), "k1", "left").select("id", "text", "k2", "spans", "k1")
    factor = T.StructType([T.StructField(c, t) for c, t in (("first", T.IntegerType()), ("length", T.IntegerType()), ("block", T.LongType()), ("offset", T.IntegerType()))])
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("factors", T.ArrayType(factor))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("block", pa.int64()), ("offset", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            n_words, n_removed, kept, factors = [], [], [], []
            k2 = batch.column(2).to_numpy()
            for i, (text, spans) in enumerate(zip(batch.column(1), batch.column(3))):
                own = (text.as_py() or "").encode().split()  # bytes.split() cuts at the six separators exactly
                n_words.append(len(own))
                parse: list[tuple[int, int, int]] = []
                if spans.is_valid:
                    mine = spans.values.field(0).to_numpy() == k2[i]
                    first, last = (spans.values.field(f).to_numpy().astype(np.int64)[mine] for f in (1, 2))
                    copied = spans.values.field(3).is_valid().to_numpy(zero_copy_only=False)[mine]
                    align = spans.values.field(3).fill_null(0).to_numpy()[mine]
                    begin, stop, align = extended(first[copied], last[copied], align[copied])
                    parse = greedy(begin, stop + window, align)
                    change = np.zeros(len(own) + 1, np.int64)
                    for at, size, _ in parse:
                        change[at] += 1
                        change[at + size] -= 1
                    np.add.at(change, first[~copied], 1)
                    np.add.at(change, last[~copied] + window, -1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own).decode())
                factors.append([{"first": at, "length": size, "block": (at + by) & -PLACES, "offset": (at + by) & (PLACES - 1)} for at, size, by in parse])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)
