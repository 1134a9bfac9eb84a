"""Streams that give each call and each bucket the numbers of the tables, once no earlier call can come."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxmeter.streaming.usage import MINUTE, as_stream_time, micros, with_default_tokens

CALL = "us long, call_id long, requests long, tokens long"
TRAILING = "api_key_id long, call_id long, us long, minute_requests long, minute_tokens long, minute_batches long"
BUCKET = "bucket timestamp, requests long, tokens long, mean_time double"


class TrailingMinute(StatefulProcessor):
    """Keeps a key's calls of the minute before the watermark and those after it; a timer goes off when the watermark has passed the earliest call that waits."""

    def __init__(self, period: int = MINUTE):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls, self.seen = handle.getListState("calls", CALL), handle.getValueState("upto", "us long")

    def waits_for(self, us: int) -> None:
        # The first millisecond that is not before the call.
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = [tuple(map(int, r)) for frame in rows for r in zip(frame["us"], frame["call_id"], frame["requests_made"], frame["tokens_used"], strict=True)]
        if calls:
            self.calls.appendList(calls)
            self.waits_for(min(c[0] for c in calls))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, done = timerValues.getCurrentWatermarkInMs() * 1000, self.seen.get()[0] if self.seen.exists() else None
        calls = sorted(tuple(c) for c in self.calls.get()) if self.calls.exists() else []
        out, low, requests, tokens = [], 0, 0, 0
        ready = [c for c in calls if c[0] <= upto]
        for i, (us, _, r, n) in enumerate(ready):
            requests, tokens = requests + r, tokens + n
            while ready[low][0] <= us - self.period:
                requests, tokens, low = requests - ready[low][2], tokens - ready[low][3], low + 1
            # Calls of one time see each other: their sums are known with the last of them.
            if i + 1 == len(ready) or ready[i + 1][0] != us:
                j = i
                while j >= 0 and ready[j][0] == us:
                    if done is None or us > done:
                        out.append((key[0], ready[j][1], us, requests, tokens, i + 1 - low))
                    j -= 1
        left = [c for c in calls if c[0] > upto - self.period]
        self.calls.put(left) if left else self.calls.clear()
        self.seen.update((upto,))
        if waiting := [c[0] for c in left if c[0] > upto]:
            self.waits_for(min(waiting))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRAILING.split(", ")])

    def close(self) -> None:
        pass


def stream_trailing_calls(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Each call with the requests, tokens and calls of its key in the minute that ends with it, as ``trailing_usage`` has them, once the watermark has passed it.

    Calls later than ``late`` are left out. A key's state is its calls of the minute before the watermark and of those after it.
    """
    s = as_stream_time(stream).withWatermark("ts", late).select(F.col("api_key_id").cast("long"), "ts", micros("ts").alias("us"), F.col("call_id").cast("long"), F.col("requests_made").cast("long"), F.col("tokens_used").cast("long"))
    return s.groupBy("api_key_id").transformWithStateInPandas(TrailingMinute(), TRAILING, "Append", "EventTime")


class GaplessBuckets(StatefulProcessor):
    """Closed buckets in order, with those between them that had no call; the state is the last bucket given."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step = self.minutes * MINUTE
        known = {int(us): (int(r), int(n), float(t)) for frame in rows for us, r, n, t in zip(frame["us"], frame["requests"], frame["tokens"], frame["mean_time"], strict=True)}
        first = self.last.get()[0] + step if self.last.exists() else min(known)
        buckets = range(min(first, min(known)), max(known) + 1, step)
        self.last.update((max(known),))
        start = datetime(1970, 1, 1, tzinfo=timezone.utc)
        out = [(start + timedelta(microseconds=us), *known.get(us, (0, 0, 0.0))) for us in buckets]
        yield pd.DataFrame(out, columns=["bucket", "requests", "tokens", "mean_time"])

    def close(self) -> None:
        pass


def stream_full_trend(stream: DataFrame, late: str = "1 hour", minutes: int = 5) -> DataFrame:
    """Buckets of ``minutes`` from the first call on, those without calls as zeros, as ``usage_trend`` has them; each once the watermark has passed its end.

    Buckets are added up in parallel; one row for each of them goes through the task that fills the gaps.
    """
    s = with_default_tokens(as_stream_time(stream)).withWatermark("ts", late)
    sums = s.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum("requests_made").alias("requests"), F.sum("tokens_used").alias("tokens"), F.avg("processing_time").alias("mean_time"))
    rows = sums.select(F.lit(0).alias("all"), F.unix_micros("w.start").alias("us"), "requests", "tokens", F.coalesce("mean_time", F.lit(0.0)).alias("mean_time"))
    return rows.groupBy("all").transformWithStateInPandas(GaplessBuckets(minutes), BUCKET, "Append", "None")
