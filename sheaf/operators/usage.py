"""Quotas, rate limits, sessions and reports over event logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZES = {"minute": 60, "hour": 3600, "day": 86400}


def bucket(ts, window: str):
    """Number of the epoch-aligned window of a time stamp."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / SIZES[window])


def quota_usage(events: DataFrame, window: str, keys: list[str], ts: str = "ts", units: str | None = None) -> DataFrame:
    used = F.count("*") if units is None else F.sum(units)
    return events.groupBy(*keys, bucket(F.col(ts), window).alias("bucket")).agg(used.alias("used"))


def quota_remaining(events: DataFrame, limits: dict[str, int], keys: list[str], now, ts: str = "ts") -> DataFrame:
    """What is left in the tightest of the windows that hold `now`; negative if more was used."""
    marks = [F.lit(limit) - F.count_if(bucket(F.col(ts), w) == bucket(now, w)) for w, limit in limits.items()]
    return events.groupBy(*keys).agg((F.least(*marks) if len(marks) > 1 else marks[0]).alias("remaining"))


def admissions(events: DataFrame, key: str, limit: int, seconds: float, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Sliding-window rate limit: each event with `allowed`. A denied event isn't counted, so decisions depend on earlier ones.

    Events are sorted within partitions by key and time and streamed through; what is held is `limit` time stamps, even for a
    key with a third of all rows.
    """
    prepared = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    dealt = prepared.repartition(key).sortWithinPartitions(key, "_us", order)
    width = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, deque()
        for b in batches:
            allowed = []
            for k, us in zip(b[key], b["_us"], strict=True):
                if k != last:
                    last, hits = k, deque()
                while hits and hits[0] <= us - width:
                    hits.popleft()
                ok = len(hits) < limit
                if ok:
                    hits.append(us)
                allowed.append(ok)
            yield b[[key, order]].assign(allowed=allowed)

    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, order))
    return dealt.mapInPandas(run, kinds + ", allowed boolean")


def sessions(events: DataFrame, key: str, gap_seconds: int, ts: str = "ts") -> DataFrame:
    """Sessions of a key: a new one begins after a gap of at least gap_seconds."""
    w = F.session_window(F.col(ts).cast("timestamp"), f"{gap_seconds} seconds")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def tumbling(events: DataFrame, width: str, keys: list[str], ts: str = "ts") -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), width)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_events", "total")


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], ts: str = "ts") -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), width, slide)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_events")


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last. Told by each number's neighbours in one sort by key and number; no table of
    distinct numbers or of runs is held."""
    w, n = Window.partitionBy(*keys).orderBy(number), F.col(number)
    starts, ends = F.coalesce(n > F.lag(number).over(w) + 1, F.lit(True)), F.coalesce(F.lead(number).over(w) > n + 1, F.lit(True))
    edges = rows.where(n.isNotNull()).select(*keys, number).withColumns({"_starts": starts, "_ends": ends}).where("_starts or _ends")
    first = F.max(F.when(F.col("_starts"), n)).over(w)  # the last start up to here, equal numbers included
    return edges.withColumn("first", first).where("_ends").select(*keys, "first", n.alias("last"))


def compressed(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Row numbers as text: 3-5, 9-11."""
    r = islands(rows, keys, number)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return r.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


RANGES = 200  # of values, of about equal numbers of distinct ones


def rates(outcomes: DataFrame, by: str | None = None) -> DataFrame:
    """Passed, failed, skipped and the pass rate of cases that weren't skipped (columns status and `by`)."""
    g = outcomes.groupBy(by) if by else outcomes.groupBy()
    p, f = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    return g.agg(F.count("*").alias("n"), p.alias("passed"), f.alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.when(p + f > 0, F.round(p / (p + f), 4)).alias("rate"))


def percentile(outcomes: DataFrame, share: float, seconds: str = "seconds", name: str = "value") -> DataFrame:
    """The value at place int(share * n) of the sorted values, by counts per value, so no list is collected.

    Counts are summed by ranges of values; only the range that holds the place is ranked, so no task takes all values.
    """
    counts = outcomes.where(F.col(seconds).isNotNull()).groupBy(F.col(seconds).alias("v")).agg(F.count("*").alias("c"))
    bounds = sorted(set(counts.approxQuantile("v", [k / RANGES for k in range(1, RANGES)], 0.5 / RANGES)))
    counts = counts.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("v"))))
    parts = counts.groupBy("part").agg(F.sum("c").alias("c")).orderBy("part").collect()  # at most RANGES rows
    n = sum(r.c for r in parts)
    place, before, part = min(n - 1, int(share * n)), 0, None
    for r in parts:
        if before + r.c > place:
            part = r.part
            break
        before += r.c
    ranked = counts.where(F.col("part") == F.lit(part)).withColumn("upto", F.lit(before) + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    return ranked.where(F.col("upto") > place).agg(F.min("v").alias(name))


def p95(outcomes: DataFrame, seconds: str = "seconds") -> DataFrame:
    return percentile(outcomes, 0.95, seconds, "p95")


def p50(outcomes: DataFrame, seconds: str = "seconds") -> DataFrame:
    return percentile(outcomes, 0.5, seconds, "p50")
