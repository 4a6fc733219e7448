"""Periodic run detection: a harmonic grid of common-extension queries over suffix arrays.

A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` whose words ``period`` apart are equal, with ``period``
the smallest such number, as long as ``least`` words and ``exponent`` periods at least, that no neighbouring word
extends.  A stretch of two periods or more holds some two grid points j*p and (j+1)*p of its period p.  So for every
period p the longest common extensions of these pairs, forward and backward, give every run of that period.

Extensions are asked of a suffix array of the words and one of the reversed words: the common prefix of two suffixes is
the least entry of the LCP array between their ranks (range minima by blocks).  Suffixes are sorted by doubling; only
those that are not yet alone are sorted again, and as two part, their common prefix follows from those known before.
Many documents are sorted at once; a document's words are keys of its own, so no extension leaves it.  A stretch that
is found with several multiples of its period keeps the least.  Where the two words of a pair differ, no run passes and
nothing is asked.

A word of a run is a repetition unless it is among the first ``period`` words of it; collapsing drops repetitions of
all runs.  Documents are whole and alone, so nothing is shuffled, and memory is about 300 bytes a word of the longest
document and of STEP_BYTES of text.

Text null, empty or of separators alone: no words and no run, collapsed to the empty text.  Null ids and repeated rows
are documents like others, an empty table gives no rows, and other columns are kept by collapse_runs() (one of the
names that it appends is replaced) and not looked at by digests().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import narrow, steps

#: Grid pairs that are looked at together.
PAIRS = 1 << 20
_FAR = np.iinfo(np.int64).max
_WIDTH = 16


@dataclass(frozen=True)
class Settings:
    least: int = 6
    exponent: int = 4


class Minima:
    """Least entries of ranges of an array: prefix and suffix minima of blocks, and a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // _WIDTH) * _WIDTH
        self.values = np.full(n, _FAR)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, _WIDTH)
        self.to = np.minimum.accumulate(blocks, 1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last, np.append(last[step:], np.full(step, _FAR))))
        self.table = np.stack(self.levels) if len(self.levels) > 1 else self.levels[0][None]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first:last + 1], range by range; no range is empty."""
        a, b = first // _WIDTH, last // _WIDTH
        out = np.minimum(self.since[first], self.to[last])
        n = b - a - 1
        wide = np.flatnonzero(n > 0)
        if len(wide):
            level = np.log2(n[wide]).astype(np.int64)
            out[wide] = np.minimum(out[wide], np.minimum(self.table[level, a[wide] + 1], self.table[level, b[wide] - (1 << level)]))
        inside = np.flatnonzero(a == b)
        if len(inside):
            at, end = first[inside], last[inside]
            least = self.values[at]
            for _ in range(_WIDTH - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[inside] = least
        return out


class Suffixes:
    """Ranks of all suffixes of ``keys`` and minima of the common prefixes of neighbours in their order."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        order = np.argsort(keys, kind="stable")
        head = np.ones(n, bool)  # first place of those that are not told apart yet
        head[1:] = keys[order[1:]] != keys[order[:-1]]
        common = np.where(head, 0, _FAR)
        rank = np.full(n + 1, -1)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        h = 1
        while True:
            open_ = ~head
            open_[:-1] |= ~head[1:]
            at = np.flatnonzero(open_)
            if not len(at):
                break
            suffix = order[at]
            sort = np.argsort(rank[suffix] * (n + 2) + rank[np.minimum(suffix + h, n)] + 1, kind="stable")
            suffix = suffix[sort]
            order[at] = suffix
            group, then = rank[suffix], rank[np.minimum(suffix + h, n)]
            parted = np.flatnonzero((group[1:] == group[:-1]) & (then[1:] != then[:-1]))
            a, b = then[parted], then[parted + 1]
            # Those behind have parted before, so what they have in common is known; one that has ended has nothing.
            known = np.zeros(len(parted), np.int64)
            some = np.flatnonzero(a >= 0)
            if len(some):
                known[some] = Minima(common).of(a[some] + 1, b[some])
            place = at[parted + 1]
            common[place] = h + known
            head[place] = True
            rank[suffix] = np.maximum.accumulate(np.where(head[at], at, 0))
            h *= 2
        self.rank, self.minima = rank[:n], Minima(common)

    def common(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many keys from ``i`` and from ``k`` on are equal, pair by pair; no two are the same."""
        a, b = self.rank[i], self.rank[k]
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b))


def find_runs(keys: np.ndarray, firsts: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period.

    ``keys``: a number for each word; document d holds those from firsts[d] to firsts[d + 1], and no key of another's.
    """
    n = np.diff(firsts)
    most = np.where(n >= s.least, n // s.exponent, 0)  # largest period
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (n[doc] - 1) // period
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in steps(pairs, PAIRS):
        m = pairs[a:b]
        p = np.repeat(period[a:b], m)
        j = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        i = np.repeat(firsts[doc[a:b]], m) + j * p
        equal = np.flatnonzero(keys[i] == keys[i + p])
        found.append((i[equal], p[equal]))
    i, p = (np.concatenate(x) for x in zip(*found)) if found else (none, none)
    if not len(i):
        return none, none, none
    forward, backward = Suffixes(keys), Suffixes(keys[::-1])
    last = len(keys) - 1
    end = i + p + forward.common(i, i + p)
    start = i + 1 - backward.common(last - i, last - i - p)
    long_ = end - start >= np.maximum(s.least, s.exponent * p)
    start, end, p = start[long_], end[long_], p[long_]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(p), bool)  # of one stretch, the least period
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def repetitions(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) > 0


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def step(texts: list[bytes], s: Settings) -> tuple[list[int], pa.Array, list[str]]:
    """Words, runs and collapsed text of each of some texts."""
    split = [t.split() for t in texts]  # at ASCII white space, which is what separates words
    counts = np.array([len(w) for w in split], np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    words = [w for ws in split for w in ws]
    keys = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys += np.repeat(np.arange(len(split)), counts) * (len(words) + 1)
    start, end, period = find_runs(keys, firsts, s)
    gone = repetitions(len(words), start, end, period)
    doc = np.searchsorted(firsts, start, "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(split) + 1))
    runs = pa.StructArray.from_arrays([pa.array(start - firsts[doc]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)
    kept = []
    for d, own in enumerate(split):
        if bounds[d] < bounds[d + 1]:
            own = [own[k] for k in np.flatnonzero(~gone[firsts[d] : firsts[d + 1]])]
        kept.append(b" ".join(own).decode())
    return counts.tolist(), lists, kept


def collapse_runs(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Append n_words, runs (start, length, period of each, by start and period) and collapsed, the text without repetitions."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {f.name for f in new}])
    schema = T.StructType([*base.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            texts = [(t.as_py() or "").encode() for t in batch.column(batch.schema.get_field_index(text))]
            for a, b in steps(np.array([len(t) for t in texts])):
                counts, runs, kept = step(texts[a:b], settings)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(counts, pa.int64()), runs, pa.array(kept, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def with_repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by a checksum of the id, has a tail that repeats.

    With h the CRC-32 of the decimal id and g = h // 10: if 10 divides h, the words from a = g % n on become repetitions
    of the first 1 + (n - a) // (3 + g % 8) of them.  Texts of rows with a null id stay.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = base.select("id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    placed = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    again: Column = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("words"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select(F.col("id").alias(doc_id), F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """n_runs, the run with most periods (start, length, period, exponent_milli), and digests of runs and collapsed text.

    Lengths and periods are exact as doubles, and so is the order of their quotients, up to some 100,000,000 words.
    """
    found = collapse_runs(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", settings)
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = found.withColumn("best", best)
    return shown.select(
        F.col("doc_id").alias(doc_id), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("best.n * 1000 div -best.p").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
