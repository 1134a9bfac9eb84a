"""Replay of a request quota: a minute that starts with the first request after the last one's end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from voxmeter.constants import REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE, TOKENS_PER_REQUEST
from voxmeter.sources.scratch import cut

MINUTE = 60_000_000
#: Times are cut into blocks of this many microseconds, which tasks take one by one.
BLOCK = 10 * MINUTE
OUT = "api_key_id long, call_id long, us long, request_tokens long, accepted boolean, reason string, wait_seconds double, used_requests long, used_tokens long"


@dataclass
class Quota:
    rpm: int = REQUESTS_PER_MINUTE
    tpm: int = TOKENS_PER_MINUTE
    per_request: int = TOKENS_PER_REQUEST
    start: int | None = None
    requests: int = 0
    tokens: int = 0

    def ask(self, us: int, tokens: int) -> tuple:
        """Whether a request passes: (accepted, reason, seconds to wait, requests and tokens used after it)."""
        if self.start is None or us - self.start >= MINUTE:
            self.start, self.requests, self.tokens = us, 0, 0
        wait = (MINUTE - (us - self.start)) / 1e6
        if self.requests >= self.rpm:
            reason = "request limit"
        elif self.tokens + tokens > self.tpm:
            reason = "token limit"
        elif tokens > self.per_request:
            reason, wait = "batch too large", 0.0
        else:
            self.requests += 1
            self.tokens += tokens
            return True, "ok", 0.0, self.requests, self.tokens
        return False, reason, wait, self.requests, self.tokens


def calls_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("api_key_id").cast("long"), F.col("call_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("tokens_used").cast("long").alias("request_tokens"))


def with_runs(calls: DataFrame) -> DataFrame:
    """Adds run, the first time since the key's last pause of a minute, which ends any window.

    Pauses are found within blocks of time, and between a key's blocks by their first and last calls.
    """
    w = W.partitionBy("api_key_id", "block").orderBy("us", "call_id")
    rows = calls.withColumn("start", F.when(F.col("us") - F.lag("us").over(w) >= MINUTE, F.col("us")))
    rows = rows.withColumn("start", F.max("start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("api_key_id").alias("k"), F.col("block").alias("b")).agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("start").alias("start_in"))
    ends = ends.withColumn("own", F.when(F.coalesce(F.col("first") - F.max("last").over(before) >= MINUTE, F.lit(True)), F.col("first")))
    ends = ends.select("k", "b", F.coalesce("own", F.max(F.greatest("start_in", "own")).over(before)).alias("carried"))
    run = rows.join(ends, F.col("api_key_id").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).withColumn("run", F.coalesce("start", "carried"))
    return run.select("api_key_id", "call_id", "us", "request_tokens", "run", "block")


def same(left: list[str], right: list[str]) -> Column:
    """Equality of keys, null ones included."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times sorted within (key, run, block), the next block's first ones included, to (k, r, b, us, to): if a window started at a time near the block's start, or at the run's, the first window of the next block would start at ``to``; none if the run ends before."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("api_key_id", "run", "block", "us"))))
    for (k, r, b), own in groupby(rows, key=lambda x: x[:3]):
        t = np.array([x[3] for x in own], dtype=np.int64)
        end = (b + 1) * BLOCK
        starts = t[(t < b * BLOCK + 2 * MINUTE) | (t == r)]
        to, never = starts.copy(), np.iinfo(np.int64).max
        t = np.append(t, never)
        # A block has no more windows than minutes.
        while (inside := to < end).any():
            to[inside] = t[np.searchsorted(t, to[inside] + MINUTE)]
        starts, to = starts[to < never], to[to < never]
        n = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(starts), pa.array(to)], names=["k", "r", "b", "us", "to"])


def true_entries(spread: DataFrame) -> DataFrame:
    """(k, r, b, entry): where the first window of each block of a run starts, but for its first block, by doubling of pointers.

    A pointer leads from a possible first start of a block to that of the next one. Starts
    known so far take all pointers at once, and pointers are joined with themselves to reach
    twice as far, so a run of n blocks takes log n turns.
    """
    tails, key = spread.where("tail"), ["api_key_id", "run", "block"]
    depth = tails.agg(F.max(F.col("block") + 1 - F.floor(F.col("run") / BLOCK))).first()[0]
    none = spread.sparkSession.createDataFrame([], "k long, r long, b long, entry long")
    if depth is None:
        return none
    groups = tails.select(*(F.col(c).alias(x) for c, x in zip(key, "krb"))).distinct()
    times = spread.join(groups, same(key, ["k", "r", "b"]), "left_semi").select(*key, "us").distinct()
    hops = cut(times.repartition(*key).sortWithinPartitions(*key, "us").mapInArrow(exits, "k long, r long, b long, us long, to long"))
    found = cut(hops.where((F.col("us") == F.col("r")) & (F.col("b") == F.floor(F.col("r") / BLOCK))).select("k", "r", (F.col("b") + 1).alias("b"), F.col("to").alias("entry")))
    hops, far = hops.select("k", "r", "us", "to"), 1
    while far < depth:
        ahead = found.join(hops.toDF("k2", "r2", "us", "to"), same(["k", "r", "entry"], ["k2", "r2", "us"])).select("k", "r", (F.col("b") + far).alias("b"), F.col("to").alias("entry"))
        found = cut(found.unionByName(ahead))
        far *= 2
        if far < depth:
            hops = cut(hops.join(hops.toDF("k2", "r2", "us2", "to2"), same(["k", "r", "to"], ["k2", "r2", "us2"])).select("k", "r", "us", F.col("to2").alias("to")))
    return found


def replay(df: DataFrame, rpm: int = REQUESTS_PER_MINUTE, tpm: int = TOKENS_PER_MINUTE, per_request: int = TOKENS_PER_REQUEST) -> DataFrame:
    """Every call with the quota's answer, keys apart, in the order of time and call.

    When windows start depends on the times alone: after a pause of a minute with the next
    call, else with the first call a minute after the last start. So starts are found first;
    then each block of time of a key is replayed by itself, from its first window's start to
    the end of its last window, which may be in the next block. A busy key without any pause
    is spread over as many tasks as it has blocks. Calls without a time or tokens have no
    answer; those without a key share one window.
    """
    calls = calls_of(df).dropna(subset=["us", "request_tokens"]).withColumn("block", F.floor(F.col("us") / BLOCK))
    rows = cut(with_runs(calls))
    # What a window may have of the next block, and where that block's first window may start, is in its first two minutes.
    early = (F.col("block") > F.floor(F.col("run") / BLOCK)) & (F.col("us") < F.col("block") * BLOCK + 2 * MINUTE)
    place = lambda back: F.struct((F.col("block") - int(back)).alias("block"), F.lit(back).alias("tail"))
    spread = rows.withColumn("at", F.explode(F.when(early, F.array(place(False), place(True))).otherwise(F.array(place(False))))).select("api_key_id", "call_id", "us", "request_tokens", "run", "at.block", "at.tail")
    key = ["api_key_id", "run", "block"]
    ready = spread.join(true_entries(spread), same(key, ["k", "r", "b"]), "left").select("api_key_id", "call_id", "us", "request_tokens", "run", "block", F.when(F.col("block") == F.floor(F.col("run") / BLOCK), F.col("run")).otherwise(F.col("entry")).alias("entry"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, quota, end = (), None, 0
        for batch in batches:
            answers, taken = [], []
            columns = (batch.column(c).to_pylist() for c in ("api_key_id", "run", "block", "us", "request_tokens", "entry"))
            for i, (k, r, b, us, n, entry) in enumerate(zip(*columns, strict=True)):
                if (k, r, b) != of:
                    of, quota, end = (k, r, b), Quota(rpm, tpm, per_request), (b + 1) * BLOCK
                # Calls before the first start, all if there is none, belong to the block before, those of a window that starts later to the next.
                if entry is not None and us >= entry and (us < end or us - quota.start < MINUTE):
                    taken.append(i)
                    answers.append(quota.ask(us, n))
            if answers:
                kinds = (pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                more = [pa.array(x, kind) for x, kind in zip(zip(*answers, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(taken)) for c in batch.columns[:4]), *more], names=[c.split()[0] for c in OUT.split(", ")])

    return ready.repartition(*key).sortWithinPartitions(*key, "us", "call_id").mapInArrow(task, OUT)


class QuotaProcessor(StatefulProcessor):
    """The same answers for a stream; a key's state is its window's start and what it used."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, requests long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quota = Quota()
        if self.state.exists():
            quota.start, quota.requests, quota.tokens = self.state.get()
        calls = pd.concat(list(rows)).sort_values(["us", "call_id"])  # one key's calls of one micro-batch
        answers = [quota.ask(int(us), int(n)) for us, n in zip(calls["us"], calls["request_tokens"], strict=True)]
        self.state.update((quota.start, quota.requests, quota.tokens))
        more = pd.DataFrame(answers, columns=["accepted", "reason", "wait_seconds", "used_requests", "used_tokens"])
        yield pd.concat([calls[["api_key_id", "call_id", "us", "request_tokens"]].reset_index(drop=True), more], axis=1)

    def close(self) -> None:
        pass


def stream_replay(stream: DataFrame) -> DataFrame:
    return calls_of(stream).groupBy("api_key_id").transformWithStateInPandas(QuotaProcessor(), OUT, "Append", "None")
