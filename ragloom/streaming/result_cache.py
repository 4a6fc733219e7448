"""The semantic result cache as a stream: results are stored and questions answered from state, with expiry in event time.

The state of a course and mode holds what cache.retention() keeps of its entries: the newest MOST_ENTRIES, none older
than TTL seconds.  A timer at the oldest entry's end drops it once the watermark is there, whether or not anything is
asked, so the state falls with the traffic.  (The state's own TTL goes by the wall clock: a replayed stream would give
other answers.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragloom.functions import text as tx
from ragloom.operators.cache import MOST_ENTRIES, THRESHOLD, TTL

ANSWERS = "course string, mode string, query_id string, entry_id string, similarity double, how string"
_COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]


class ResultCache(StatefulProcessor):
    """Entries by id: created (microseconds), hash of the question, its vector."""

    def __init__(self, threshold: float = THRESHOLD, most: int = MOST_ENTRIES, ttl: int = TTL):
        self.threshold, self.most, self.ttl = threshold, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "entry_id string", "created long, hash string, embedding array<double>")

    def live(self, entries: dict, us: int) -> dict:
        """Entries that are not yet older than ``ttl`` whole seconds at ``us``."""
        return {k: e for k, e in entries.items() if e[0] // 1_000_000 > us // 1_000_000 - self.ttl}

    def newest(self, entries: dict) -> dict:
        """The ``most`` newest; of equal times those with the greater ids."""
        if len(entries) <= self.most:
            return entries
        return dict(sorted(entries.items(), key=lambda e: (e[1][0], e[0]))[-self.most :])

    def answer(self, entries: dict, hash: str, vector: np.ndarray | None) -> tuple | None:
        same = [(e[0], k) for k, e in entries.items() if e[1] == hash]
        if same:
            return max(same)[1], 1.0, "exact"
        if vector is None or not len(vector):
            return None
        own = float(np.linalg.norm(vector))
        scored = []
        for k, e in entries.items():
            if e[2] is not None and len(e[2]) == len(vector):
                length = own * float(np.linalg.norm(e[2]))
                scored.append((float(np.floor(float(np.dot(vector, e[2])) / length * 10_000 + 0.5) / 10_000) if length else 0.0, e[0], k))
        best = max(scored, default=None)
        return (best[2], best[0], "nearest") if best and best[0] >= self.threshold else None

    def end(self, entries: dict) -> int:
        """Milliseconds at which the oldest entry is over."""
        return (min(e[0] for e in entries.values()) // 1_000_000 + self.ttl) * 1000

    def keep(self, before: dict, entries: dict) -> None:
        for k in before.keys() - entries.keys():
            self.entries.removeKey((k,))
        for k, e in entries.items():
            if before.get(k) is not e:
                self.entries.updateValue((k,), e)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if entries:
            self.handle.registerTimer(self.end(entries))

    def known(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.known()
        entries, out = dict(before), []
        events = pd.concat(list(rows)).sort_values(["us", "asked", "id"], kind="stable")
        for e in events.itertuples():
            vector = None if e.embedding is None else np.asarray(e.embedding, np.float64)
            if e.asked:
                found = self.answer(self.newest(self.live(entries, int(e.us))), e.hash, vector)
                out.append((*key, e.id, *(found or (None, None, "none"))))
            else:
                entries[e.id] = (int(e.us), e.hash, None if vector is None else vector.tolist())
                entries = self.newest(entries)
        self.keep(before, self.live(entries, timerValues.getCurrentWatermarkInMs() * 1000))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        before = self.known()
        self.keep(before, self.live(before, timerValues.getCurrentWatermarkInMs() * 1000))
        yield pd.DataFrame(columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_lookups(events: DataFrame, late: str = "10 minutes", threshold: float = THRESHOLD, most: int = MOST_ENTRIES, ttl: int = TTL) -> DataFrame:
    """An answer (how: exact, nearest or none) for every question of a stream.

    events: course, mode, ts, asked (true: a question, false: a result to store), id, query, embedding.  At one time
    results come before questions.  A question sees what has come before it; a result that comes late, by no more than
    ``late``, takes its place by its time for the questions after it, and what is later still is dropped.  Results that
    repeat an id replace it.  Needs the RocksDB state store.
    """
    ts = F.col("ts").cast("timestamp")
    timed = events.select("course", "mode", ts.alias("ts"), "asked", F.col("id").cast("string").alias("id"), tx.query_hash(F.col("query"), F.col("mode")).alias("hash"), F.col("embedding").cast("array<double>").alias("embedding"))
    # What is not after the first watermark, which is 1970 itself, would count as late.
    rows = timed.withColumn("us", F.unix_micros("ts")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).withWatermark("ts", late)
    return rows.groupBy("course", "mode").transformWithStateInPandas(ResultCache(threshold, most, ttl), outputStructType=ANSWERS, outputMode="append", timeMode="eventTime")
