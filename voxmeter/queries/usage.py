"""Usage and timing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter import constants as K
from voxmeter.queries.registry import HELPERS, query, rounded
from voxmeter.sources import io
from voxmeter.sources.scratch import scratch_path
from voxmeter.streaming import quota, usage

C = F.col
HELPERS["minutes"] = """SELECT *, CAST(sum(requests_made) OVER w AS BIGINT) AS minute_requests, CAST(sum(tokens_used) OVER w AS BIGINT) AS minute_tokens, count(*) OVER w AS minute_batches FROM api_usage
WINDOW w AS (PARTITION BY api_key_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW)"""
HELPERS["fives"] = "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS bucket, CAST(sum(requests_made) AS BIGINT) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, avg(processing_time) AS mean_time FROM api_usage GROUP BY 1"
HELPERS["every_five"] = "SELECT unnest(generate_series((SELECT min(bucket) FROM fives), (SELECT max(bucket) FROM fives), INTERVAL 5 MINUTES)) AS bucket"


@query("SELECT call_id, minute_requests, minute_tokens, minute_batches FROM minutes")
def j1_trailing_usage(t):
    return usage.trailing_usage(t.api_usage).select("call_id", "minute_requests", "minute_tokens", "minute_batches")


@query("SELECT strftime(e.bucket, '%Y-%m-%d %H:%M') AS bucket, strftime(e.bucket, '%H:%M') AS label, coalesce(requests, 0) AS requests, coalesce(tokens, 0) AS tokens, round(coalesce(mean_time, 0.0), 6) AS mean_time FROM every_five e LEFT JOIN fives f ON e.bucket = f.bucket")
def j2_usage_trend(t):
    return rounded(usage.usage_trend(t.api_usage).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm")))


HELPERS["hour"] = """SELECT CAST(p.place AS BIGINT) AS place, coalesce(requests, 0) AS requests, coalesce(tokens, 0) AS tokens, round(coalesce(mean_time, 0.0), 6) AS mean_time FROM (SELECT unnest(range(12)) AS place) p LEFT JOIN (
SELECT least(11, (epoch_us(ts) - (e - 3600000000)) // 300000000) AS place, CAST(sum(requests_made) AS BIGINT) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, avg(processing_time) AS mean_time FROM api_usage, (SELECT max(epoch_us(ts)) AS e FROM api_usage) WHERE epoch_us(ts) > e - 3600000000 GROUP BY 1) g ON p.place = g.place"""


@query("SELECT * FROM hour")
def j2_hourly_trend(t):
    return rounded(usage.hourly_trend(t.api_usage))


@query("SELECT call_id, CASE WHEN call_id % 3 = 0 THEN CAST(batch_size * 150 AS BIGINT) ELSE tokens_used END AS tokens_used FROM api_usage")
def j3_default_tokens(t):
    u = t.api_usage.withColumn("tokens_used", F.when(C("call_id") % 3 != 0, C("tokens_used")))
    return usage.with_default_tokens(u).select("call_id", "tokens_used")


@query("SELECT call_id FROM api_usage, (SELECT max(epoch_us(ts)) AS e FROM api_usage) WHERE epoch_us(ts) > e - 3600000000")
def j3_retained(t):
    return usage.retained(t.api_usage).select("call_id")


# A call of every key at each turn: the window's state goes from a key's call to its next.
REPLAY = """SELECT api_key_id, call_id, us, request_tokens, reason = 'ok' AS accepted, reason, CASE WHEN reason IN ('request limit', 'token limit') THEN (60000000 - (us - start)) / 1000000.0 ELSE 0.0 END::DOUBLE AS wait_seconds, requests AS used_requests, tokens AS used_tokens FROM (
WITH RECURSIVE numbered AS (SELECT api_key_id, call_id, epoch_us(ts) AS us, tokens_used AS request_tokens, row_number() OVER (PARTITION BY api_key_id ORDER BY ts, call_id) AS k FROM api_usage),
turns AS (
 SELECT DISTINCT api_key_id, NULL::BIGINT AS call_id, NULL::BIGINT AS us, NULL::BIGINT AS request_tokens, 0::BIGINT AS k, NULL::BIGINT AS start, 0::BIGINT AS requests, 0::BIGINT AS tokens, '' AS reason FROM numbered
 UNION ALL
 SELECT api_key_id, call_id, us, request_tokens, k, start, CASE WHEN reason = 'ok' THEN requests + 1 ELSE requests END, CASE WHEN reason = 'ok' THEN tokens + request_tokens ELSE tokens END, reason FROM (
  SELECT *, CASE WHEN requests >= 3 THEN 'request limit' WHEN tokens + request_tokens > 30000 THEN 'token limit' WHEN request_tokens > 12000 THEN 'batch too large' ELSE 'ok' END AS reason FROM (
   SELECT c.*, CASE WHEN t.start IS NULL OR c.us - t.start >= 60000000 THEN c.us ELSE t.start END AS start, CASE WHEN t.start IS NULL OR c.us - t.start >= 60000000 THEN 0 ELSE t.requests END AS requests, CASE WHEN t.start IS NULL OR c.us - t.start >= 60000000 THEN 0 ELSE t.tokens END AS tokens
   FROM turns t JOIN numbered c ON c.api_key_id = t.api_key_id AND c.k = t.k + 1)))
SELECT * FROM turns WHERE k > 0)"""


@query(REPLAY)
def j4_j7_quota_replay(t):
    return quota.replay(t.api_usage, rpm=3, tpm=30_000)


HELPERS["islands"] = "SELECT *, sum(CAST(NOT rate_limited AND error_count = 0 AS INT)) OVER (PARTITION BY api_key_id ORDER BY ts, call_id) AS island FROM api_usage"
HELPERS["streaks"] = "SELECT call_id, rate_limited, CAST(sum(CAST(rate_limited AS INT)) OVER (PARTITION BY api_key_id, island ORDER BY ts, call_id) AS BIGINT) AS streak FROM islands"


@query("SELECT call_id, streak, CASE WHEN rate_limited THEN greatest(0.1, least(2.0, 0.5 * pow(1.5, least(streak, 3)))) ELSE 0.0 END AS backoff FROM streaks")
def j5_rate_limit_backoff(t):
    return usage.rate_limit_backoff(t.api_usage).select("call_id", "streak", "backoff")


@query("SELECT call_id, round(minute_requests * 100.0 / 450, 6) AS requests_pct, round(minute_tokens * 100.0 / 200000, 6) AS tokens_pct FROM minutes")
def j6_utilisation(t):
    return rounded(usage.utilisation(t.api_usage).select("call_id", "requests_pct", "tokens_pct"))


HELPERS["tiers"] = f"SELECT provider, tier, CAST(floor(rpm * 0.9) AS BIGINT) AS rpm, CAST(floor(tpm * 0.9) AS BIGINT) AS tpm FROM (VALUES {', '.join(map(str, K.TIERS))}) v(provider, tier, rpm, tpm)"


@query("SELECT provider, tier, count(*) AS calls, count_if(minute_requests > rpm OR minute_tokens > tpm) AS over_limit FROM minutes CROSS JOIN tiers GROUP BY provider, tier")
def j8_usage_by_tier(t):
    return usage.usage_by_tier(t.api_usage, usage.tier_limits(t.spark))


SUMMARY = "SELECT CAST(sum(requests_made) AS BIGINT) AS total_requests, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, count(*) AS total_batches, round(avg(batch_size), 6) AS mean_batch_size, CAST(sum(error_count) AS BIGINT) AS total_errors, count_if(rate_limited) AS rate_limit_incidents, round(avg(processing_time), 6) AS mean_processing_time FROM api_usage"
HELPERS["session"] = SUMMARY


@query(SUMMARY)
def g23_session_summary(t):
    return rounded(usage.session_summary(t.api_usage))


@query("SELECT call_id, CASE WHEN greatest(minute_requests / 3, minute_tokens / 20000) >= 0.9 THEN 'critical' WHEN greatest(minute_requests / 3, minute_tokens / 20000) >= 0.75 THEN 'warning' ELSE 'ok' END AS alert, CASE WHEN greatest(minute_requests / 3, minute_tokens / 20000) > 0.8 THEN 'warning' ELSE 'ok' END AS secondary FROM minutes")
def g24_usage_alerts(t):
    u, r, n = usage.trailing_usage(t.api_usage), C("minute_requests"), C("minute_tokens")
    return u.select("call_id", usage.alert(r, n, 3, 20_000).alias("alert"), usage.secondary_alert(r, n, 3, 20_000).alias("secondary"))


ADVICE = [
    ("false", "Consider reducing concurrent batch processing to avoid rate limits"),
    ("true", "Consider reducing batch size or comment length to manage token usage"),
    ("mean_processing_time > 30", "Processing time is high - consider optimizing prompts or reducing batch size"),
    ("rate_limit_incidents > 0", "Rate limiting detected - consider upgrading API tier or reducing request rate"),
    ("total_errors > total_batches * 0.1", "High error rate detected - check API configuration and network connectivity"),
    ("mean_batch_size < 20", "Small batch sizes detected - consider increasing batch size for better efficiency"),
]


@query("SELECT *, concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{a}' END" for c, a in ADVICE) + ") AS recommendations FROM session")
def g25_usage_recommendations(t):
    return rounded(usage.recommendations(usage.session_summary(t.api_usage), F.lit(10.0), F.lit(90.0)))


OK = "CASE WHEN error_count = 0 THEN {} END"
D, S = OK.format("processing_time"), OK.format("batch_size")
HELPERS["calls"] = f"SELECT sla_category, count(*) AS total, count_if(error_count = 0) AS successes, avg({D}) AS mean, min({D}) AS min, max({D}) AS max, avg({S}) AS mean_size, min({S}) AS min_size, max({S}) AS max_size, sum({S}) / sum({D}) AS throughput, quantile_cont({D}, 0.5) AS p50, quantile_cont({D}, 0.95) AS p95, quantile_cont({D}, 0.99) AS p99 FROM api_usage GROUP BY sla_category"


@query("SELECT sla_category, total, successes, total - successes AS failures, round(successes * 100.0 / total, 6) AS success_rate, min_size, max_size, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "min", "max", "mean_size", "throughput", "p50", "p95", "p99")) + " FROM calls")
def g26_call_stats(t):
    return rounded(usage.call_stats(t.api_usage))


HELPERS["targets"] = f"SELECT * FROM (VALUES {', '.join(f'({c!r}, {v}::DOUBLE)' for c, v in K.SLA_TARGETS)}) v(sla_category, target)"
HELPERS["late"] = "SELECT u.sla_category, count_if(error_count = 0 AND processing_time > target) AS violations, avg(CASE WHEN error_count = 0 AND processing_time > target THEN processing_time END) AS mean_violation FROM api_usage u JOIN targets t ON u.sla_category = t.sla_category GROUP BY u.sla_category"


@query("""SELECT c.sla_category, target, violations, round((successes - violations) * 100.0 / successes, 6) AS compliance_rate, round(coalesce(mean_violation, 0.0), 6) AS mean_violation, round(p50, 6) AS p50, p50 <= target AS compliant, round(greatest(0.0, p50 - target), 6) AS severity,
 coalesce(nullif(concat_ws('; ', CASE WHEN successes * 100.0 / total < 95 THEN 'Investigate and fix error causes to improve reliability' END, CASE WHEN (p50 / target - 1) * 100 > 50 THEN 'Critical performance issue - major optimization needed' WHEN (p50 / target - 1) * 100 > 20 THEN 'Significant performance degradation - optimization recommended' WHEN p50 > target THEN 'Minor performance issue - fine-tuning recommended' END), ''), 'Performance within acceptable parameters') AS recommendation
FROM calls c JOIN targets t ON c.sla_category = t.sla_category JOIN late l ON c.sla_category = l.sla_category WHERE successes > 0""")
def g27_sla_compliance(t):
    return rounded(usage.sla_compliance(t.api_usage, usage.sla_table(t.spark)))


@query("SELECT round(r / greatest(s, 1), 6) AS requests_per_second, round(n / greatest(s, 1), 6) AS tokens_per_second, round(n / greatest(r, 1), 6) AS tokens_per_request, round(s * 1000 / greatest(b, 1), 6) AS ms_per_comment FROM (SELECT sum(requests_made) AS r, sum(tokens_used) AS n, sum(processing_time) AS s, sum(batch_size) AS b FROM api_usage)")
def g28_throughput(t):
    return rounded(usage.throughput(t.api_usage))


CURRENT = "(SELECT coalesce(sum(requests_made), 0) AS requests, coalesce(sum(tokens_used), 0) AS tokens, count(*) AS batches FROM api_usage, (SELECT max(epoch_us(ts)) AS e FROM api_usage) WHERE epoch_us(ts) > e - 60000000)"
LONG = lambda dataset, names, table, place="": " UNION ALL ".join(f"SELECT '{dataset}' AS dataset, '{n}'{place} AS name, round(CAST({n} AS DOUBLE), 6) AS value FROM {table}" for n in names)
SESSION = ["total_requests", "total_tokens", "total_batches", "mean_batch_size", "total_errors", "rate_limit_incidents", "mean_processing_time"]


@query(" UNION ALL ".join([LONG("summary", SESSION, "session"), LONG("trends", ["requests", "tokens", "mean_time"], "hour", " || ' ' || place"), LONG("current", ["requests", "tokens", "batches"], CURRENT), "SELECT 'limits', 'requests_per_minute', 450.0::DOUBLE UNION ALL SELECT 'limits', 'tokens_per_minute', 200000.0::DOUBLE"]))
def a9_usage_export(t):
    """The exported files read again, one row per number."""
    path = scratch_path(t.spark, "usage")
    usage.export_usage(t.api_usage, path)
    parts, files = [], io.read_bundle(t.spark, path)
    for dataset, names in (("summary", SESSION), ("trends", ["requests", "tokens", "mean_time"]), ("current", ["requests", "tokens", "batches"]), ("limits", ["requests_per_minute", "tokens_per_minute"])):
        place = F.concat(F.lit(" "), C("place").cast("string")) if dataset == "trends" else F.lit("")
        numbers = F.array(*[F.struct(F.concat(F.lit(n), place).alias("name"), C(n).cast("double").alias("value")) for n in names])
        parts.append(files[dataset].select(F.lit(dataset).alias("dataset"), F.inline(numbers)))
    return rounded(usage.union_logs(*parts))


@query("SELECT call_id, u.sla_category AS function_name, processing_time AS duration, CAST(batch_size AS BIGINT) AS input_size, error_count = 0 AS success, target FROM api_usage u LEFT JOIN targets s ON u.sla_category = s.sla_category")
def a10_call_log_export(t):
    """The exported log with its targets, read again."""
    path = scratch_path(t.spark, "calls")
    usage.export_calls(t.api_usage, usage.sla_table(t.spark), path)
    files = io.read_bundle(t.spark, path)
    targets = files["sla_targets"].withColumnRenamed("sla_category", "function_name")
    return files["call_log"].join(F.broadcast(targets), "function_name", "left").drop("ts")
