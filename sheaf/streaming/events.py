"""Streaming forms: windowed usage with late data, stream dedup, and keyed state for rate limits, breakers and job leases.

Keyed state lives by event time: it goes when the watermark (`late` behind the newest event) has passed the time at which it can
matter no more, so the store holds active keys alone. Events behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stamped(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need time stamps with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_usage(events: DataFrame, width: str, late: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Counts per key and tumbling window; rows later than the watermark are dropped."""
    w = F.window(ts, width)
    return stamped(events, ts).withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("used")).select(*keys, F.col("w.start").alias("window_start"), "used")


def distinct_events(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    return stamped(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep(state: GroupState, value: tuple, until_us: int) -> None:
    """Keeps a key's state until event time has passed `until_us`."""
    state.update(value)
    state.setTimeoutTimestamp(max(until_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def by_key(rows: DataFrame, key: str, step, out: str, kept: str, late: str, ts: str) -> DataFrame:
    """A keyed step over event time; a key whose time is over loses its state and gives no rows."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
        else:
            yield from step(k, batches, state)

    timed = stamped(rows, ts).withWatermark(ts, late).withColumn("_us", F.unix_micros(ts))
    return timed.groupBy(key).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, key: str, limit: int, seconds: float, ts: str = "ts", order: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Sliding-window rate limit: key, order, allowed. State per key is the time stamps of the last `limit` allowed events, until the
    last of them has left the window."""
    width = int(seconds * 1_000_000)
    kind = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["_us", order])
        allowed = []
        for us in rows["_us"]:
            hits = [h for h in hits if h > us - width]
            ok = len(hits) < limit
            if ok:
                hits.append(int(us))
            allowed.append(ok)
        keep(state, (hits,), (hits[-1] if hits else 0) + width)
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "allowed": allowed})

    return by_key(events.select(key, order, ts), key, step, f"`{key}` {kind[key]}, `{order}` {kind[order]}, allowed boolean", "hits array<bigint>", late, ts)


def breaker(calls: DataFrame, key: str, failures: int = 5, recovery_seconds: float = 30, ts: str = "ts", order: str = "event_id", ok: str = "ok", late: str = "1 hour", forget_seconds: float = 86_400) -> DataFrame:
    """Circuit breaker: key, order, state (closed, open, half-open) at each call. Calls while open aren't made and change nothing.

    A closed breaker without failures has no state; others are forgotten `forget_seconds` after their last call.
    """
    width = int(recovery_seconds * 1_000_000)
    kind = {c: calls.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bad, since = state.get if state.exists else (0, -1)
        rows, out = pd.concat(list(batches)).sort_values(["_us", order]), []
        for us, good in zip(rows["_us"], rows[ok], strict=True):
            now = "closed" if since < 0 else "half-open" if us - since >= width else "open"
            out.append(now)
            if now != "open":
                bad = 0 if good else bad + 1
                since = int(us) if not good and (bad >= failures or now == "half-open") else -1 if good else since
        if bad or since >= 0:
            keep(state, (int(bad), int(since)), int(rows["_us"].iloc[-1]) + int(forget_seconds * 1_000_000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "state": out})

    return by_key(calls.select(key, order, ok, ts), key, step, f"`{key}` {kind[key]}, `{order}` {kind[order]}, state string", "bad bigint, since bigint", late, ts)


def leases(claims: DataFrame, job: str, seconds: float = 30, attempts: int = 3, ts: str = "ts", worker: str = "worker", late: str = "1 hour", forget_seconds: float = 86_400) -> DataFrame:
    """Job leases: each claim, renewal or release with `outcome`: granted, renewed, released, refused or failed (no attempt left). A job
    is forgotten, with its attempts, `forget_seconds` after its last event or lease."""
    width = int(seconds * 1_000_000)
    kind = {c: claims.schema[c].dataType.simpleString() for c in (job, worker)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, until, tries = state.get if state.exists else ("", -1, 0)
        rows, out = pd.concat(list(batches)).sort_values("_us", kind="stable"), []
        for us, who, action in zip(rows["_us"], rows[worker], rows["action"], strict=True):
            held = holder != "" and us < until
            if action == "claim":
                if held:
                    out.append("refused")
                elif tries >= attempts:
                    out.append("failed")
                else:
                    holder, until, tries = str(who), int(us) + width, tries + 1
                    out.append("granted")
            elif not held or holder != str(who):
                out.append("refused")
            elif action == "renew":
                until = int(us) + width
                out.append("renewed")
            else:
                holder, until = "", -1
                out.append("released")
        keep(state, (holder, int(until), int(tries)), max(int(until), int(rows["_us"].iloc[-1])) + int(forget_seconds * 1_000_000))
        yield pd.DataFrame({job: k[0], worker: rows[worker].to_numpy(), "us": rows["_us"].to_numpy(), "outcome": out})

    out = f"`{job}` {kind[job]}, `{worker}` {kind[worker]}, us bigint, outcome string"
    return by_key(claims.select(job, worker, "action", ts), job, step, out, "holder string, until bigint, tries bigint", late, ts)
