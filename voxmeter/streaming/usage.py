"""Usage and timing logs of API calls, as tables and as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmeter.constants import REQUESTS_PER_MINUTE, SAFETY_MARGIN, SLA_TARGETS, TIERS, TOKENS_PER_COMMENT, TOKENS_PER_MINUTE
from voxmeter.operators.quantiles import percentiles
from voxmeter.operators.reports import share
from voxmeter.sources.io import write_bundle

MINUTE = 60_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_usage(df: DataFrame, key: str = "api_key_id", ts: str = "ts", period: int = MINUTE, block: int = 60 * MINUTE) -> DataFrame:
    """Each call with the requests, tokens and batches of its key in the minute that ends with it.

    Time is cut into blocks and a block also sees the calls of the period before it, so one
    key's calls are spread over many tasks.
    """
    at = F.col("__us")
    rows = df.withColumn("__us", micros(ts)).withColumn("__own", F.floor(at / block))
    seen = rows.withColumn("__block", F.explode(F.when(F.floor((at + period - 1) / block) > F.col("__own"), F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    w = W.partitionBy(key, "__block").orderBy("__us").rangeBetween(1 - period, 0)
    out = seen.withColumns({"minute_requests": F.sum("requests_made").over(w), "minute_tokens": F.sum("tokens_used").over(w), "minute_batches": F.count("*").over(w)})
    return out.where(F.col("__block") == F.col("__own")).drop("__us", "__own", "__block")


def usage_trend(df: DataFrame, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Requests, tokens and mean time of each five-minute bucket from the first call to the last; buckets without calls are 0."""
    got = df.groupBy(F.window(F.col(ts).cast("timestamp"), width)["start"].alias("bucket")).agg(F.sum("requests_made").alias("requests"), F.sum("tokens_used").alias("tokens"), F.avg("processing_time").alias("mean_time"))
    span = got.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low is not null")
    every = span.select(F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {width}"))).alias("bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(got, "bucket", "left").select("bucket", F.date_format("bucket", "HH:mm").alias("label"), zero("requests"), zero("tokens"), F.coalesce("mean_time", F.lit(0.0)).alias("mean_time"))


def hourly_trend(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The twelve five-minute buckets of the hour that ends with the last call."""
    end = df.agg(F.max(micros(ts)).alias("end"))
    place = F.floor((micros(ts) - (F.col("end") - 60 * MINUTE)) / (5 * MINUTE))
    got = df.crossJoin(F.broadcast(end)).where(micros(ts) > F.col("end") - 60 * MINUTE).withColumn("place", F.least(place, F.lit(11))).groupBy("place").agg(F.sum("requests_made").alias("requests"), F.sum("tokens_used").alias("tokens"), F.avg("processing_time").alias("mean_time"))
    every = end.where("end is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("place"))
    return every.join(got, "place", "left").select("place", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("mean_time", F.lit(0.0)).alias("mean_time"))


def with_default_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens_used", F.coalesce("tokens_used", F.col("batch_size") * TOKENS_PER_COMMENT).cast("long"))


def retained(df: DataFrame, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """Calls of the hour before the last call."""
    end = df.agg(F.max(micros(ts)).alias("__end"))
    return df.crossJoin(F.broadcast(end)).where(micros(ts) > F.col("__end") - seconds * 1_000_000).drop("__end")


def session_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("requests_made").alias("total_requests"), F.sum("tokens_used").alias("total_tokens"), F.count("*").alias("total_batches"), F.avg("batch_size").alias("mean_batch_size"), F.sum("error_count").alias("total_errors"), F.count_if("rate_limited").alias("rate_limit_incidents"), F.avg("processing_time").alias("mean_processing_time"))


def alert(requests: Column, tokens: Column, rpm: int = REQUESTS_PER_MINUTE, tpm: int = TOKENS_PER_MINUTE) -> Column:
    """critical from 90 % of a limit, warning from 75 %."""
    top = F.greatest(requests / rpm, tokens / tpm)
    return F.when(top >= 0.9, "critical").when(top >= 0.75, "warning").otherwise("ok")


def secondary_alert(requests: Column, tokens: Column, rpm: int = REQUESTS_PER_MINUTE, tpm: int = TOKENS_PER_MINUTE) -> Column:
    return F.when(F.greatest(requests / rpm, tokens / tpm) > 0.8, "warning").otherwise("ok")


def recommendations(summary: DataFrame, requests_pct: Column, tokens_pct: Column) -> DataFrame:
    """Advice on a session summary; its wording is fixed."""
    found = F.array_compact(
        F.array(
            F.when(requests_pct > 80, "Consider reducing concurrent batch processing to avoid rate limits"),
            F.when(tokens_pct > 80, "Consider reducing batch size or comment length to manage token usage"),
            F.when(F.col("mean_processing_time") > 30, "Processing time is high - consider optimizing prompts or reducing batch size"),
            F.when(F.col("rate_limit_incidents") > 0, "Rate limiting detected - consider upgrading API tier or reducing request rate"),
            F.when(F.col("total_errors") > F.col("total_batches") * 0.1, "High error rate detected - check API configuration and network connectivity"),
            F.when(F.col("mean_batch_size") < 20, "Small batch sizes detected - consider increasing batch size for better efficiency"),
        )
    )
    advice = F.when(F.col("total_batches") == 0, F.array(F.lit("No usage data available for recommendations"))).when(F.size(found) == 0, F.array(F.lit("Usage patterns look healthy - no specific recommendations"))).otherwise(found)
    return summary.withColumn("recommendations", F.array_join(advice, "|"))


def call_stats(df: DataFrame, by: str = "sla_category") -> DataFrame:
    """Per category: totals, success rate, durations of the successes with linear percentiles, input sizes, throughput."""
    ok = F.col("error_count") == 0
    d, n = F.when(ok, F.col("processing_time")), F.when(ok, F.col("batch_size"))
    out = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("successes"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(n).alias("mean_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.try_divide(F.sum(n), F.sum(d)).alias("throughput"))
    p = percentiles(df, d, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, [by]).withColumnRenamed(by, "__by")
    out = out.join(p, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return out.withColumns({"failures": F.col("total") - F.col("successes"), "success_rate": share(F.col("successes"), F.col("total"))})


def sla_table(spark) -> DataFrame:
    return spark.createDataFrame(SLA_TARGETS, "sla_category string, target double")


def sla_compliance(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Compliance of each category that has a target and a success. targets: a handful of rows."""
    late = (F.col("error_count") == 0) & (F.col("processing_time") > F.col("target"))
    counts = df.join(F.broadcast(targets), "sla_category").groupBy("sla_category").agg(F.max("target").alias("target"), F.count_if(late).alias("violations"), F.avg(F.when(late, F.col("processing_time"))).alias("mean_violation"))
    s = call_stats(df).where("successes > 0").join(counts, "sla_category")
    over = (F.col("p50") / F.col("target") - 1) * 100
    advice = F.array_compact(
        F.array(
            F.when(F.col("success_rate") < 95, "Investigate and fix error causes to improve reliability"),
            F.when(over > 50, "Critical performance issue - major optimization needed").when(over > 20, "Significant performance degradation - optimization recommended").when(over > 0, "Minor performance issue - fine-tuning recommended"),
            F.when(F.col("mean_size") > 1000, "Consider batch size optimization for large datasets"),
        )
    )
    return s.select("sla_category", "target", "violations", share(F.col("successes") - F.col("violations"), F.col("successes")).alias("compliance_rate"), F.coalesce("mean_violation", F.lit(0.0)).alias("mean_violation"), "p50", (F.col("p50") <= F.col("target")).alias("compliant"), F.greatest(F.lit(0.0), F.col("p50") - F.col("target")).alias("severity"), F.when(F.size(advice) == 0, "Performance within acceptable parameters").otherwise(F.array_join(advice, "; ")).alias("recommendation"))


def throughput(df: DataFrame) -> DataFrame:
    r, t, s, n = (F.sum(c) for c in ("requests_made", "tokens_used", "processing_time", "batch_size"))
    least = lambda x: F.greatest(x, F.lit(1))
    return df.agg((r / least(s)).alias("requests_per_second"), (t / least(s)).alias("tokens_per_second"), (t / least(r)).alias("tokens_per_request"), (s * 1000 / least(n)).alias("ms_per_comment"))


def rate_limit_backoff(df: DataFrame, key: str = "api_key_id", order: tuple[str, ...] = ("ts", "call_id"), block: int = 60 * MINUTE) -> DataFrame:
    """Each call with its streak of rate-limit errors since the key's last success, and the wait it asks for (0 without a streak).

    Time is cut into blocks: streaks are counted within each, and what a block begins with
    follows from the ends of the key's blocks before it, so one key's calls are spread over
    many tasks. ``order`` begins with the time.
    """
    ok = ~F.col("rate_limited") & (F.col("error_count") == 0)
    rows = df.withColumn("__block", F.floor(micros(order[0]) / block))
    w = W.partitionBy(key, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__limited", F.sum(F.col("rate_limited").cast("int")).over(w))
    # Errors up to the block's last success so far; null before the first.
    rows = rows.withColumn("__at", F.max(F.when(ok, F.col("__limited"))).over(w))
    ends = rows.groupBy(F.col(key).alias("__k"), F.col("__block").alias("__b")).agg(F.max("__limited").alias("total"), F.max("__at").alias("at"))
    before = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("sums", F.coalesce(F.sum(F.col("total") - F.coalesce("at", F.lit(0))).over(before), F.lit(0)))
    ends = ends.select("__k", "__b", (F.col("sums") - F.coalesce(F.max(F.when(F.col("at").isNotNull(), F.col("sums"))).over(before), F.lit(0))).alias("carried"))
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")))
    streak = F.col("__limited") - F.coalesce("__at", F.lit(0)) + F.when(F.col("__at").isNull(), F.col("carried")).otherwise(0)
    wait = F.greatest(F.lit(0.1), F.least(F.lit(2.0), 0.5 * F.pow(F.lit(1.5), F.least(F.col("streak"), F.lit(3)))))
    return rows.withColumn("streak", streak).withColumn("backoff", F.when(F.col("rate_limited"), wait).otherwise(0.0)).select(*df.columns, "streak", "backoff")


def export_usage(df: DataFrame, path: str, rpm: int = REQUESTS_PER_MINUTE, tpm: int = TOKENS_PER_MINUTE) -> None:
    """Session summary, hourly trend, usage of the minute that ends with the last call, and limits, as one bundle of JSON."""
    end = F.col("__end")
    last = df.agg(F.max(micros("ts")).alias("__end"))
    current = df.crossJoin(F.broadcast(last)).where(micros("ts") > end - MINUTE).agg(F.coalesce(F.sum("requests_made"), F.lit(0)).alias("requests"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.count("*").alias("batches"))
    limits = df.sparkSession.createDataFrame([(rpm, tpm)], "requests_per_minute long, tokens_per_minute long")
    write_bundle({"summary": session_summary(df), "trends": hourly_trend(df), "current": current, "limits": limits}, path)


def export_calls(df: DataFrame, targets: DataFrame, path: str) -> None:
    """The whole call log, and the targets it is held to, as one bundle of JSON."""
    log = df.select(F.col("sla_category").alias("function_name"), F.col("processing_time").alias("duration"), "ts", F.col("batch_size").alias("input_size"), (F.col("error_count") == 0).alias("success"), "call_id")
    write_bundle({"call_log": log, "sla_targets": targets}, path)


def utilisation(df: DataFrame, rpm: int = REQUESTS_PER_MINUTE, tpm: int = TOKENS_PER_MINUTE) -> DataFrame:
    """Trailing usage as percent of the limits."""
    return trailing_usage(df).withColumns({"requests_pct": share(F.col("minute_requests"), F.lit(rpm)), "tokens_pct": share(F.col("minute_tokens"), F.lit(tpm))})


def tier_limits(spark, workers: int = 4, margin: float = SAFETY_MARGIN) -> DataFrame:
    """Limits of each provider's tiers with the safety margin, the delay between requests and the concurrency."""
    t = spark.createDataFrame(TIERS, "provider string, tier string, rpm long, tpm long")
    safe = lambda c: F.floor(F.col(c) * margin).cast("long")
    return t.select("provider", "tier", safe("rpm").alias("rpm"), safe("tpm").alias("tpm"), F.greatest(F.lit(0.1), 60 / safe("rpm")).alias("delay"), F.least(F.lit(workers), F.floor(F.col("rpm") * margin / 5)).cast("int").alias("concurrency"))


def usage_by_tier(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each tier's share of calls whose key was beyond the tier's limits in their minute. tiers: a handful of rows."""
    used = trailing_usage(df).groupBy("minute_requests", "minute_tokens").agg(F.count("*").alias("n"))
    over = (F.col("minute_requests") > F.col("rpm")) | (F.col("minute_tokens") > F.col("tpm"))
    return used.join(F.broadcast(tiers)).groupBy("provider", "tier").agg(F.sum("n").alias("calls"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("over_limit"))


# Streams


def as_stream_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_trailing_usage(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sliding minutes, every ten seconds, per key."""
    s = as_stream_time(stream).withWatermark("ts", late)
    return s.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "api_key_id").agg(F.sum("requests_made").alias("requests"), F.sum("tokens_used").alias("tokens"), F.count("*").alias("batches")).select(F.col("w.start").alias("start"), "api_key_id", "requests", "tokens", "batches")


def stream_trend(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Five-minute buckets; the same numbers as ``usage_trend`` where there were calls."""
    s = with_default_tokens(as_stream_time(stream)).withWatermark("ts", late)
    return s.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.sum("requests_made").alias("requests"), F.sum("tokens_used").alias("tokens"), F.avg("processing_time").alias("mean_time")).select(F.col("w.start").alias("bucket"), "requests", "tokens", "mean_time")


def stream_alerts(stream: DataFrame) -> DataFrame:
    return stream_trailing_usage(stream).withColumn("alert", alert(F.col("requests"), F.col("tokens")))


def union_logs(*logs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, logs)
