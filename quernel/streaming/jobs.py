"""Streaming twins of the stateful operators. Each takes a streaming DataFrame; the caller starts the query with its checkpoint."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stamped(events: DataFrame) -> DataFrame:
    """Event times as timestamps with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def service_levels(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", step: str = "30 seconds") -> DataFrame:
    """(slot, n, errors) of sliding windows; events later than the watermark are dropped by Spark."""
    w = F.window("ts", size, step)
    return stamped(events).withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("slot"), "n", "errors")


def token_bucket(events: DataFrame, rate: float, capacity: float, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, allowed): a bucket for each user, full at first, refilled with ``rate`` tokens a second.

    Within a micro-batch the events of a user are taken in order of time. The state of a user without
    events for so long that the bucket is full again is dropped when the watermark passes; events later than it are dropped by Spark.
    """
    full = max(1, int(1000 * capacity / rate)) if rate > 0 else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            tokens = min(capacity, tokens + rate * max(0.0, now - last)) if last is not None else tokens
            last = now if last is None else max(last, now)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        if full:
            state.setTimeoutTimestamp(max(int(1000 * last) + full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    slim = stamped(events).select("user_id", "event_id", "ts").withWatermark("ts", late)
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout if full else GroupStateTimeout.NoTimeout)


_TAIL = re.compile(r"\[\d{0,9}$")
_MARK = re.compile(r"\[(\d{1,9})\]")


def citation_filter(pieces: DataFrame, sources: int) -> DataFrame:
    """(stream_id, seq, text) of pieces(stream_id, seq, text): marks [n] beyond ``sources`` are removed, also where a mark is split
    between pieces: an open mark at the end of a piece waits for the next one. A piece with ``text`` null ends its stream and its state."""

    def clean(s: str) -> str:
        return _MARK.sub(lambda m: m[0] if 1 <= int(m[1]) <= sources else "", s)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, ended = state.get[0] if state.exists else "", False
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.text is None or pd.isna(r.text):
                out.append((key[0], r.seq, rest))
                rest, ended = "", True
                continue
            ended, whole = False, rest + r.text
            m = _TAIL.search(whole)
            rest = whole[m.start() :] if m else ""
            out.append((key[0], r.seq, clean(whole[: m.start()] if m else whole)))
        if not ended:
            state.update((rest,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return pieces.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq bigint, text string", "rest string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once by event_id within the watermark: writing them again changes nothing."""
    return stamped(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
