"""Token budgets: a sliding minute, a token bucket and a daily quota, over tables and over streams.

Batch forms are window frames and one ordered fold; the streaming form keeps a user's state with
transformWithState, a single writer for each user.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Of each role the tokens a minute, a bucket's size, a refill a second and the tokens a day.
THRESHOLDS = {"student": (50_000, 80_000, 800.0, 500_000), "teacher": (150_000, 250_000, 2_500.0, 2_000_000)}
WINDOW_SECONDS = 60
#: Microseconds of a day.
DAY = 86_400_000_000
#: The least wait that a full window names, and the tokens that a bucket should hold again.
LEAST_WAIT, ENOUGH = 5, 500


def thresholds(role: Column, place: int) -> Column:
    table = F.create_map(*[F.lit(x) for r, t in THRESHOLDS.items() for x in (r, float(t[place]))])
    return F.element_at(table, F.coalesce(role, F.lit("student")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_usage(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Append ``used_window``: tokens of the same user and mode in the ``seconds`` before each event, its own left out.

    An event exactly ``seconds`` old has left the window.  Events with 0 tokens or fewer use nothing.
    """
    own = Window.partitionBy("user_id", "mode").orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, -1)
    spent = F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(0)
    return events.withColumn("__us", micros(F.col("ts"))).withColumn("used_window", F.coalesce(F.sum(spent).over(own), F.lit(0))).drop("__us")


def daily_usage(events: DataFrame) -> DataFrame:
    """Append ``used_day``: tokens of the same user earlier on the same UTC day (ties in the order of event_id)."""
    own = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(0)
    return events.withColumn("used_day", F.coalesce(F.sum(spent).over(own), F.lit(0)))


def bucket_levels(events: DataFrame, capacity: float, rate: float) -> DataFrame:
    """user_id, event_id and ``available``: what a user's bucket holds right before each event is deducted.

    An event refills the bucket up to ``capacity`` and then deducts, not under 0.  Any run of events
    maps a level x to max(low, min(high, x + shift)), so each day of a user is folded to these three
    numbers, the days are chained, and each day is then replayed from its own first level: no
    more than a user's day is ever held together.
    """
    full = F.lit(float(capacity))
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    rows = events.select("user_id", "event_id", micros(F.col("ts")).alias("us"), F.greatest(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"))
    filled = rows.withColumn("refill", F.coalesce((F.col("us") - before) / 1e6 * rate, F.lit(0.0))).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    days = filled.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "refill", "tokens"))).alias("rows"))

    def chain(s, r):
        """The map of a run, and then of one event: refill under a cap, deduct over a floor."""
        bound = lambda x: F.greatest(F.lit(0.0), F.least(full, x + r["refill"]) - r["tokens"])
        return F.struct((s["shift"] + r["refill"] - r["tokens"]).alias("shift"), bound(s["low"]).alias("low"), bound(s["high"]).alias("high"))

    same = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    folded = days.select("user_id", "day", F.aggregate("rows", same, chain).alias("map"))
    after = lambda x, m: F.greatest(m["low"], F.least(m["high"], x + m["shift"]))
    start = F.struct(full.alias("level"), F.array().cast("array<double>").alias("seen"))
    seen = F.aggregate("days", start, lambda s, d: F.struct(after(s["level"], d["map"]).alias("level"), F.array_append(s["seen"], s["level"]).alias("seen")), lambda s: s["seen"])
    chained = folded.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "map"))).alias("days")).withColumn("seen", seen)
    first = chained.select("user_id", F.explode(F.arrays_zip("days", "seen")).alias("z")).select("user_id", F.col("z.days.day").alias("day"), F.col("z.seen").alias("level"))
    level = lambda s, r: F.least(full, s["level"] + r["refill"])
    replay = F.aggregate(
        "rows", F.struct(F.col("level").alias("level"), F.array().cast("array<double>").alias("seen")),
        lambda s, r: F.struct(F.greatest(level(s, r) - r["tokens"], F.lit(0.0)).alias("level"), F.array_append(s["seen"], level(s, r)).alias("seen")), lambda s: s["seen"])
    played = days.join(first, ["user_id", "day"]).withColumn("seen", replay)
    return played.select("user_id", F.explode(F.arrays_zip("rows", "seen")).alias("z")).select("user_id", F.col("z.rows.event_id").alias("event_id"), F.col("z.seen").alias("available"))


def decisions(events: DataFrame) -> DataFrame:
    """Append used_window, used_day, available, allowed, reason and retry_after.

    events: event_id, user_id, mode, role, ts, tokens.  The first tier that fails is reported: window,
    bucket, day.  The check does not reserve anything, so use can overshoot by what runs at once.
    """
    used = daily_usage(sliding_usage(events))
    levels = None
    for role, (_, capacity, rate, _) in THRESHOLDS.items():
        part = bucket_levels(events.where(F.coalesce("role", F.lit("student")) == role), capacity, rate)
        levels = part if levels is None else levels.unionByName(part)
    joined = used.join(levels, ["user_id", "event_id"], "left")
    minute, rate, day = (thresholds(F.col("role"), i) for i in (0, 2, 3))
    reason = F.when(F.col("used_window") >= minute, "window").when(F.col("available") < 1, "bucket").when(F.col("used_day") >= day, "day")
    midnight = F.unix_timestamp(F.date_add(F.to_date("ts"), 1).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    wait = F.when(reason == "window", F.greatest(F.lit(float(LEAST_WAIT)), WINDOW_SECONDS * (F.col("used_window") - minute) / F.col("used_window")))
    wait = wait.when(reason == "bucket", F.greatest(F.lit(1.0), (ENOUGH - F.col("available")) / rate)).when(reason == "day", midnight.cast("double"))
    return joined.select("*", reason.isNull().alias("allowed"), reason.alias("reason"), F.ceil(wait).alias("retry_after"))


def usage(events: DataFrame, now: Column) -> DataFrame:
    """Per user and mode the tokens of the last minute (its start included) and, over all modes, of the UTC day."""
    recent = (micros(F.col("ts")) >= micros(now) - WINDOW_SECONDS * 1_000_000) & (micros(F.col("ts")) <= micros(now))
    today = F.to_date("ts") == F.to_date(now)
    by_mode = events.groupBy("user_id", "mode").agg(F.sum(F.when(recent, F.col("tokens")).otherwise(0)).alias("last_minute"), F.sum(F.when(today, F.col("tokens")).otherwise(0)).alias("day_of_mode"))
    return by_mode.withColumn("day", F.sum("day_of_mode").over(Window.partitionBy("user_id"))).drop("day_of_mode")


def headers(decided: DataFrame) -> DataFrame:
    """Append ``headers``: limit, used and remaining of the window, and the wait, as JSON."""
    minute = thresholds(F.col("role"), 0)
    parts = F.struct(minute.cast("long").alias("limit"), F.col("used_window").cast("long").alias("used"), F.greatest(minute - F.col("used_window"), F.lit(0)).cast("long").alias("remaining"), F.col("retry_after"))
    return decided.withColumn("headers", F.to_json(parts))


class Limiter(StatefulProcessor):
    """A user's last minute, a bucket for each role, and the day; each event is checked, then recorded.

    What a user's state says is no more than a fresh one once the minute, the day and every bucket's refill are over.
    A timer at that time, in event time, forgets the user, so the state holds active users alone and decisions stay as
    if nothing were forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "seq long", "us long, mode string, tokens double")
        self.buckets = handle.getMapState("buckets", "role string", "level double, us long")
        self.day = handle.getValueState("day", "day long, used double, seq long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        day, used, seq, timer = self.day.get() if self.day.exists() else (-1, 0.0, 0, -1)
        recent = {k[0]: tuple(v) for k, v in self.recent.iterator()} if self.recent.exists() else {}
        buckets = {k[0]: tuple(v) for k, v in self.buckets.iterator()} if self.buckets.exists() else {}
        before, out, newest, end = dict(recent), [], 0, 0
        for e in events.itertuples():
            role = e.role if e.role in THRESHOLDS else "student"
            minute, capacity, rate, quota = THRESHOLDS[role]
            us, today = int(e.us), int(e.us) // DAY
            used, day = (used if today == day else 0.0), today
            level, last = buckets.get(role, (capacity, us))
            level = min(capacity, level + max(0, us - last) / 1e6 * rate)
            recent = {k: v for k, v in recent.items() if v[0] > us - WINDOW_SECONDS * 1_000_000}
            window = sum(v[2] for v in recent.values() if v[1] == e.mode and v[0] < us)
            reason = "window" if window >= minute else "bucket" if level < 1 else "day" if used >= quota else None
            waits = {"window": lambda: max(float(LEAST_WAIT), WINDOW_SECONDS * (window - minute) / window), "bucket": lambda: max(1.0, (ENOUGH - level) / rate), "day": lambda: (today + 1) * DAY / 1e6 - us // 1_000_000}
            out.append((key[0], e.event_id, window, level, used, reason is None, reason, math.ceil(waits[reason]()) if reason else None))
            spent = max(float(e.tokens), 0.0)
            used += spent
            buckets[role] = (max(level - spent, 0.0), us)
            recent[seq] = (us, e.mode, spent)
            seq, newest = seq + 1, max(newest, us)
            end = max(end, us + int(capacity / rate * 1e6))
        for k in before.keys() - recent.keys():
            self.recent.removeKey((k,))
        for k in recent.keys() - before.keys():
            self.recent.updateValue((k,), recent[k])
        for role in events["role"].where(events["role"].isin(list(THRESHOLDS)), "student").unique():
            self.buckets.updateValue((role,), buckets[role])
        due = max(end, newest + WINDOW_SECONDS * 1_000_000, (newest // DAY + 1) * DAY) // 1000 + 1
        if due > timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.day.update((day, used, seq, timer))
        made = pd.DataFrame(out, columns=["user_id", "event_id", "used_window", "available", "used_day", "allowed", "reason", "retry_after"])
        yield made.astype({"retry_after": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.buckets.clear()
        self.day.clear()
        yield pd.DataFrame(columns=["user_id", "event_id", "used_window", "available", "used_day", "allowed", "reason", "retry_after"])

    def close(self) -> None:
        pass


DECISIONS = "user_id long, event_id long, used_window double, available double, used_day double, allowed boolean, reason string, retry_after long"


def stream_decisions(events: DataFrame, role: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Decisions over a stream (event_id, user_id, mode, role, ts, tokens), each event by its own role.

    As decisions() gives them, if a user's events come in the order of their times; one that comes after later ones, by
    no more than ``late``, is checked against what is known then, and one beyond is dropped.  ``role`` stands for the
    column where the stream has none.  Needs the RocksDB state store; with its states encoded as Avro
    (spark.sql.streaming.stateStore.encodingFormat) a later version may add fields to them.
    """
    own = F.lit(role) if role or "role" not in events.columns else F.col("role")
    timed = events.select("event_id", F.col("user_id").cast("long").alias("user_id"), "mode", own.alias("role"), F.col("ts").cast("timestamp").alias("ts"), F.col("tokens").cast("double").alias("tokens"))
    # What is not after the first watermark, which is 1970 itself, would count as late.
    rows = timed.withColumn("us", F.unix_micros("ts")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Limiter(), outputStructType=DECISIONS, outputMode="append", timeMode="eventTime")


def stream_daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens of each user and UTC day of a stream, out once the day is over and ``late`` has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.window("ts", "1 day")).agg(F.sum("tokens").alias("used")).select("user_id", F.to_date("window.start").alias("day"), "used")


def recorded(calls: DataFrame) -> DataFrame:
    """The second phase: what successful calls with tokens used, once they are over (``ok``, ``tokens``)."""
    return calls.where(F.coalesce("ok", F.lit(False)) & (F.col("tokens") > 0))


def without_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Limits reset: the spending of all users but these."""
    return events.join(users.select("user_id").distinct(), "user_id", "left_anti")
