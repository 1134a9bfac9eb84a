"""Golden values, invariants, and what SQL cannot express."""

from __future__ import annotations

import random
from datetime import timedelta
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from voxmeter import constants as K
from voxmeter.functions import churn, emotion, nps, responses, text
from voxmeter.operators import batching, joins, quality, quantiles, reports, scoring
from voxmeter.plans import pipeline
from voxmeter.queries import ORACLES, QUERIES
from voxmeter.queries.registry import Tables
from voxmeter.sources import io, scratch
from voxmeter.streaming import live, quota, usage


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_constants():
    assert len(K.EMOTIONS) == 16
    assert sorted(e for v in K.CATEGORIES.values() for e in v) == sorted(K.EMOTIONS)
    assert sum(abs(w) for w in K.NPS_WEIGHTS.values()) == pytest.approx(29.4)
    assert [len(v) for v in K.ALIASES.values()] == [10, 7, 7]


@pytest.mark.parametrize(("raw", "expected"), [("8/10", 8), ("4/5", 4), ("80%", 8), ("80/100", 8), ("NPS: 10", 10), ("nps10", 1), ("11", None), ("8.5", 8), ("Excelente", 9), ("muy malo", 3), ("n/a", None), (None, None)])
def test_nps_parse(spark, raw, expected):
    assert one(spark, raw, text.nps_parse) == expected


@pytest.mark.parametrize(("raw", "expected"), [("que?!?!", "que!"), ("hoooola", "hoola"), ("lllll", "lllll"), ("q tal , x favor.Gracias", "que tal, por favor. Gracias"), (None, None)])
def test_fix_common(spark, raw, expected):
    assert one(spark, raw, text.fix_common) == expected


def test_clean_comment_cuts_at_a_word(spark):
    assert one(spark, "  hola\t mundo <b>&; ", text.clean_comment) == "hola mundo b"
    assert one(spark, "ab " * 1000, text.clean_comment) == ("ab " * 667)[:1999].rsplit(" ", 1)[0] + "..."
    assert one(spark, "x" * 3000, text.clean_comment) == "x" * 2000 + "..."
    assert one(spark, None, text.clean_comment) == ""


def test_normalize_text(spark):
    assert one(spark, "<p>Ã¡rbol &amp; café…  „hola‚ —  fin....</p>", text.normalize_text) == "árbol & café… \"hola' - fin."
    assert one(spark, "café", lambda c: text.normalize_text(c, accents=False)) == "cafe"


@pytest.mark.parametrize(("score", "expected"), [(6.9, "detractor"), (8.9, "passive"), (10.0, "promoter"), (None, "unknown"), (11.0, "unknown")])
def test_nps_category(spark, score, expected):
    assert one(spark, score, nps.category, "double") == expected


def emotions(spark, **values):
    df = spark.createDataFrame([(values.pop("sentiment", "neutral"), values.pop("churn_risk", 0.0))], "sentiment string, churn_risk double")
    return df.withColumns({e: F.lit(float(values.get(e, 0))) for e in K.EMOTIONS})


def test_inference(spark):
    s, c = F.col("sentiment"), F.col("churn_risk")
    assert emotions(spark).select(nps.infer(s, c), F.round(nps.inference_confidence(s, c), 9)).first()[:] == (6.0, 0.2)
    assert emotions(spark, entusiasmo=0.9, gratitud=0.8, sentiment="positive", churn_risk=0.1).select(nps.infer(s, c)).first()[0] == 7.6
    assert emotions(spark).select(emotion.dominant()).first()[0] == "alegria"


def test_churn_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (None,), (1.0,)], "churn_risk double")
    assert [tuple(r)[:2] for r in reports.churn_bins(df).collect()] == [("Bajo", 1), ("Medio", 1), ("Alto", 1)]
    assert [r[0] for r in df.select(churn.category(F.col("churn_risk"))).limit(3).collect()] == ["low", "medium", "high"]
    four = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.6, 0.9)], "churn_risk double")
    assert reports.churn_distribution(four).first()["median"] == 0.6
    empty = df.limit(0)
    assert [r["n"] for r in reports.churn_bins(empty).collect()] == [0, 0, 0]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in reports.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0)
    assert got[("a", "c")] is None


def test_columns(spark):
    df = spark.createDataFrame([("1", "2", "x")], [" NPS Score", "Calificación", "Comentario Final Limpio"])
    assert io.rename_columns(df).columns == K.REQUIRED_COLUMNS
    with pytest.raises(ValueError, match="several columns"):
        io.rename_columns(df.toDF("score", "puntaje", "texto"))
    with pytest.raises(ValueError, match="missing"):
        io.require_columns(df)
    with pytest.raises(ValueError, match="rows"):
        quality.require_size(df.limit(0))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'di"jo,\nhola', ["a", "b"])], "comment_id long, comment string, pain_points array<string>")
    bundle = {"Analisis_Completo": df, "Otro": df.select("comment_id")}
    io.write_csv(bundle, str(tmp_path / "out.csv"))
    io.write_json(bundle, str(tmp_path / "json"))
    io.write_parquet(bundle, str(tmp_path / "parquet"))
    assert io.read_comments(spark, str(tmp_path / "out.csv")).first()["pain_points"] == "a, b"
    assert spark.read.json(str(tmp_path / "json/Otro")).count() == 1
    assert spark.read.parquet(str(tmp_path / "parquet/Analisis_Completo")).first() == df.first()
    with pytest.raises(ValueError, match="unknown format"):
        io.read_comments(spark, "x.doc")


def test_run_pipeline_from_a_file(spark, tmp_path):
    rows = [("9", "5", "Excelente servicio, genial"), ("n/a", "-1", "El servicio es terrible, muy lento"), (None, None, "12 34"), ("3", "2", None)]
    spark.createDataFrame(rows, ["Score", "Nota", "Comentario"]).write.option("header", True).csv(str(tmp_path / "in.csv"))
    out = pipeline.run_pipeline(spark, str(tmp_path / "in.csv"))
    got = {r.sentiment: r for r in out["results"].collect()}
    assert set(got) == {"positive", "negative"}
    assert got["positive"].nps == 9 and not got["positive"].nps_was_inferred
    assert got["negative"].nps_was_inferred and got["negative"].nota is None
    assert out["summary"].first()["total"] == 2


def commented(spark, path, n):
    rows = [("9", "5", f"comentario {i} excelente") for i in range(n)]
    spark.createDataFrame(rows, ["Score", "Nota", "Comentario"]).coalesce(1).write.option("header", True).csv(path)
    return path


def counting(log, fatal=None):
    """A scorer that notes in a file what it has answered; it takes its worker down at the comment ``fatal``."""

    def scorer(comments):
        if any(fatal and fatal in c for c in comments):
            import os

            os._exit(1)
        with open(log, "a") as f:
            f.write("|".join(comments) + "\n")
        return [{"churn_risk": 0.9, "sentiment": "negative"}] * len(comments)

    return scorer


def calls(log):
    return [line.split("|") for line in open(log).read().splitlines()]


def test_a_comment_is_asked_once_whatever_is_taken(spark, tmp_path):
    path, log, kept = commented(spark, str(tmp_path / "in.csv"), 50), str(tmp_path / "log"), str(tmp_path / "answers")
    out = pipeline.run_pipeline(spark, path, scorer=counting(log), batch_size=20, answers=kept)
    assert out["results"].count() == 50 and out["summary"].first()["high_churn"] == 50
    out["metrics"].collect(), out["results"].collect()
    asked = calls(log)
    assert sorted(map(len, asked)) == [10, 20, 20]
    assert sorted((c for call in asked for c in call), key=lambda c: int(c.split()[1])) == [f"comentario {i} excelente" for i in range(50)]
    # The rows of a batch are in the file's order, and another run over the same file asks nothing.
    rows = out["results"].orderBy("batch_id", "pos").collect()
    assert [r.comment for r in rows] == [f"comentario {i} excelente" for i in range(50)] and [r.comment_id for r in rows] == list(range(50))
    again = pipeline.run_pipeline(spark, path, scorer=counting(log), batch_size=20, answers=kept)
    assert again["results"].where("sentiment = 'negative'").count() == 50 and len(calls(log)) == 3
    # Batches of other sizes are other calls.
    pipeline.run_pipeline(spark, path, scorer=counting(log), batch_size=50, answers=kept)
    assert len(calls(log)) == 4


def test_a_failed_run_goes_on_where_it_ended(spark, tmp_path):
    """The worker dies in one call; no batch that was answered and committed is asked again."""
    path, log, kept = commented(spark, str(tmp_path / "in.csv"), 60), str(tmp_path / "log"), str(tmp_path / "answers")
    with pytest.raises(Exception, match="(?i)worker|job aborted|crash"):
        pipeline.run_pipeline(spark, path, scorer=counting(log, "comentario 43 "), batch_size=5, answers=kept)
    known = {c for r in spark.read.parquet(kept).select("batch_id").collect() for c in [r.batch_id]}
    assert known and 8 not in known
    first = len(calls(log))
    out = pipeline.run_pipeline(spark, path, scorer=counting(log), batch_size=5, answers=kept)
    assert out["results"].where("churn_risk = 0.9").count() == 60
    again = calls(log)[first:]
    assert sorted(int(call[0].split()[1]) // 5 for call in again) == sorted(set(range(12)) - known)


def test_tasks_of_a_round_of_calls_do_not_grow_with_the_comments(spark, tmp_path):
    df = spark.range(1001, numPartitions=2).select(F.col("id").alias("batch_id"), F.lit(0).alias("pos"), F.concat(F.lit("texto "), F.col("id")).alias("comment"))
    replies = scoring.ask(scratch.written(scoring.gathered(df), "batches"), scoring.lexicon_scorer, str(tmp_path / "answers"))
    assert replies.count() == 1001 and replies.where("is_fallback[0]").count() == 0
    assert len([f for f in (tmp_path / "answers").glob("*.parquet")]) <= 1000


def test_batch_size_follows_the_limits(spark, tmp_path):
    path, log = commented(spark, str(tmp_path / "in.csv"), 60), str(tmp_path / "log")
    usage_now = {"remaining_tokens": 100_000, "tokens_per_minute": 150_000, "remaining_requests": 400, "used_share": 0.8, "rate_limit_streak": 1}
    pipeline.run_pipeline(spark, path, scorer=counting(log), batch_size=40, usage=usage_now)
    size = batching.size_now(spark, usage_now, 40)
    assert size < 40 and sorted(map(len, calls(log)), reverse=True) == [size] * (60 // size) + [60 % size] * bool(60 % size)


def test_reports_seen_on_the_way_are_those_of_a_pass_of_their_own(spark, tmp_path):
    rows = [("9", "5", "Excelente servicio"), ("80%", None, "Excelente servicio"), ("85%", "-2", "muy malo todo"), (None, "1", "ok, bien " * 300), ("3", "2", None), ("4", "2", "12 34")]
    spark.createDataFrame(rows, ["Score", "Nota", "Comentario"]).write.option("header", True).csv(str(tmp_path / "in.csv"))
    out = pipeline.run_pipeline(spark, str(tmp_path / "in.csv"))
    df = io.rename_columns(io.read_comments(spark, str(tmp_path / "in.csv"))).withColumnsRenamed({"NPS": "nps_raw", "Nota": "nota", "Comentario Final": "comment"})
    for name, report in pipeline.validate(pipeline.clean(df)).items():
        assert out[f"{name}_check"].collect() == report.collect()
    with pytest.raises(ValueError, match="too many"):
        pipeline.run_pipeline(spark, str(tmp_path / "in.csv"), max_rows=2)
    spark.createDataFrame([("9", "5", "x")], ["Score", "Nota", "Comentario"]).write.option("header", True).csv(str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="no rows"):
        pipeline.run_pipeline(spark, str(tmp_path / "none.csv"))


def test_rows_keep_the_order_of_the_files(spark, tmp_path):
    df = spark.range(0, 2000, numPartitions=7).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))
    df.write.parquet(str(tmp_path / "in.parquet"))
    read = io.with_origin(spark.read.parquet(str(tmp_path / "in.parquet"))).where("id % 3 = 0").withColumn(io.NUMBER, F.monotonically_increasing_id())
    got = io.with_row_number(scratch.written(read, "t"), "n")
    assert got.columns == ["id", "t", "n"] and {int(r.id): r.n for r in got.collect()} == {i: i // 3 for i in range(0, 2000, 3)}


def test_the_run_numbers_a_table_of_several_files_as_its_sql(spark, sf_dir, tmp_path):
    """Spark reads large files first; the SQL goes by ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, part in enumerate(("doc_id < 30", "doc_id >= 30 AND doc_id < 180", "doc_id >= 180")):
        docs.where(part).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"{k}").glob("part-*.parquet")).rename(tmp_path / f"documents.parquet/part-{k}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT comment_id, batch_id, pos FROM ({ORACLES['p6_run_pipeline']})").fetchall()
    got = QUERIES["p6_run_pipeline"](spark, str(tmp_path)).select("comment_id", "batch_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scorer_failures_are_fallbacks(spark):
    df = spark.createDataFrame([(1, "bueno"), (2, None)], "comment_id long, comment string")

    def broken(comments):
        raise RuntimeError

    def short(comments):
        return ['{"churn_risk": 0.9}']

    assert all(r.is_fallback for r in scoring.score_comments(df, broken).collect())
    got = {r.comment_id: r.is_fallback for r in scoring.score_comments(df.coalesce(1), short).collect()}
    assert sorted(got.values()) == [False, True]
    scoring.register("length", lambda: F.length("comment"))
    assert scoring.analyze(df, ["length"]).columns == ["comment_id", "comment", "length"]


def test_responses_of_odd_kinds(spark):
    rows = [(1, 2, '[{"emotions": 5, "pain_points": "x", "churn_risk": null, "sentiment": 3}'), (2, 2, "{'churn_risk': 0.25, sentiment: 'positive'}"), (3, 0, "[]"), (4, 1, None)]
    df = spark.createDataFrame(rows, "batch_id long, expected_count int, content string")
    got = {(r.batch_id, r.pos): r for r in responses.normalized(responses.response_rows(df)).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (2, 1), (4, 0)]
    assert got[(2, 0)].churn_risk == 0.25 and got[(2, 0)].sentiment == "positive" and not got[(2, 0)].is_fallback
    assert got[(1, 0)].churn_risk == 0.5 and got[(1, 0)].pain_points == []
    assert got[(4, 0)].is_fallback


def test_fixed_batches_are_full(spark):
    df = spark.range(1000).repartition(7)
    got = batching.fixed_batches(df, "id", 30).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in got) == [10] + [30] * 33
    assert {r.id: (r.batch_id, r.pos) for r in batching.fixed_batches(df, "id", 30).collect()} == {i: (i // 30, i % 30) for i in range(1000)}


def test_quota_rules():
    q = quota.Quota(rpm=2, tpm=1000, per_request=600)
    assert q.ask(0, 500)[:2] == (True, "ok")
    assert q.ask(1, 700)[:2] == (False, "token limit")
    assert q.ask(2, 500)[:2] == (True, "ok")
    assert q.ask(30_000_000, 0)[:3] == (False, "request limit", 30.0)
    assert q.ask(60_000_000, 700)[:2] == (False, "batch too large")
    # A hundred short comments ask for more tokens than a small limit has.
    assert quota.Quota(rpm=10, tpm=1000).ask(0, int((800 + 100) * 1.5))[1] == "token limit"


def replayed(rows):
    """The rules by themselves, a window per key."""
    windows, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.us, r.call_id)):
        start, n, used = windows.get(r.api_key_id, (None, 0, 0))
        if start is None or r.us - start >= 60_000_000:
            start, n, used = r.us, 0, 0
        left = (60_000_000 - (r.us - start)) / 1e6
        if n >= 3:
            answer = (False, "request limit", left, n, used)
        elif used + r.request_tokens > 30_000:
            answer = (False, "token limit", left, n, used)
        elif r.request_tokens > 12_000:
            answer = (False, "batch too large", 0.0, n, used)
        else:
            n, used = n + 1, used + r.request_tokens
            answer = (True, "ok", 0.0, n, used)
        windows[r.api_key_id] = (start, n, used)
        out[r.call_id] = answer
    return out


def test_dense_calls_are_replayed_and_counted_like_the_plain_loop(spark):
    """Pauses and streaks across the borders of time blocks, equal times, and calls without a key, a time or tokens."""
    rng = random.Random(2)
    rows, us = [], {k: 0 for k in (1, 2, 3, None)}
    for i in range(1500):
        k = rng.choice([1, 1, 1, 2, 3, None])
        us[k] += rng.choice([0, 1_000_000, 20_000_000, 59_999_999, 60_000_000, 200_000_000, 4_000_000_000])
        limited = rng.random() < 0.4
        rows.append((i, k, us[k], rng.choice([100, 9000, 13_000]), limited, int(limited or rng.random() < 0.2)))
    df = spark.createDataFrame([*rows, (9000, 1, None, 5, False, 0), (9001, 1, 70_000_000, None, False, 0)], "call_id long, api_key_id long, us long, tokens_used long, rate_limited boolean, error_count int").withColumn("ts", F.timestamp_micros("us"))
    calls = quota.calls_of(df).dropna(subset=["us", "request_tokens"]).collect()
    got = {r.call_id: (r.accepted, r.reason, r.wait_seconds, r.used_requests, r.used_tokens) for r in quota.replay(df, rpm=3, tpm=30_000).collect()}
    assert got == replayed(calls)
    streaks, want = {}, {}
    for i, k, _, _, limited, errors in sorted(rows, key=lambda r: (r[2], r[0])):
        streaks[k] = streaks.get(k, 0) + 1 if limited else 0 if not errors else streaks.get(k, 0)
        want[i] = streaks[k]
    assert {r.call_id: r.streak for r in usage.rate_limit_backoff(df.where("call_id < 9000")).collect()} == want


def test_a_bundle_is_there_as_a_whole_or_not(spark, tmp_path):
    path, df = str(tmp_path / "bundle"), spark.range(100)
    broken = df.select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).alias("id"))
    with pytest.raises(ValueError, match="no complete bundle"):
        io.read_bundle(spark, path)
    with pytest.raises(Exception, match="killed"):
        io.write_bundle({"a": df, "b": broken}, path)
    with pytest.raises(ValueError, match="no complete bundle"):
        io.read_bundle(spark, path)
    io.write_bundle({"a": df, "b": df.where("id < 5")}, path, "parquet")
    with pytest.raises(Exception, match="killed"):
        io.write_bundle({"a": df.where("id < 7"), "b": broken}, path)
    assert {k: v.count() for k, v in io.read_bundle(spark, path).items()} == {"a": 100, "b": 5}
    io.write_bundle({"c": df.where("id < 3")}, path)
    assert {k: v.count() for k, v in io.read_bundle(spark, path).items()} == {"c": 3}


def test_estimates_of_distinct_values(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).cast("double").alias("x"), F.concat(F.lit("comment "), F.col("id") % 50_000).alias("comment"))
    exact, about = (quality.describe(df, ["x"], exact=e).first().distinct_values for e in (True, False))
    assert exact == 20_000 and abs(about - exact) <= 0.03 * exact
    exact, about = (quality.validate_comments(df, exact=e).first().duplicates for e in (True, False))
    assert exact == 10_000 and abs(about - exact) <= 0.03 * 50_000


def test_thousands_of_keywords_are_joined_by_equality(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    keys = [(i, f"c{i % 50}", word(rng.choice((1, 2, 5, 6, 7)) if i > 9990 else rng.choice((5, 6, 7, 8)))) for i in range(10_000)]
    texts = [word(rng.randrange(12)) for _ in range(200)] + ["zzz", "", None, "éé"]
    keywords = spark.createDataFrame([*keys, (10_001, "none", None)], "ord int, category string, keyword string")
    points = spark.createDataFrame([(t,) for t in texts * 2], "pain_point string")
    got = joins.keyword_lookup(points, keywords)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = {t: next((c for _, c, k in keys if t is not None and k in t), "otros") for t in texts}
    assert {r.pain_point: r.category for r in got.collect()} == want
    everything = spark.createDataFrame([(0, "all", ""), (1, "x", "zz")], keywords.schema)
    assert {r.category for r in joins.keyword_lookup(points.dropna(), everything).collect()} == {"all"}
    assert {r.category for r in joins.keyword_lookup(points, keywords.limit(0)).collect()} == {"otros"}


def sorted_ranks(values, p):
    import numpy as np

    return float(np.quantile(values, p))


@pytest.mark.parametrize("limit", [20, 10**6])
def test_percentiles_are_exact_at_every_size(spark, monkeypatch, limit):
    """By sketches and counts of ranges, and where all fits at once; with ties, signs, groups of one value and none."""
    monkeypatch.setattr(quantiles, "SORTED", limit)
    rng = random.Random(4)
    groups = {"even": [rng.uniform(-5, 5) for _ in range(3000)], "ties": [rng.choice([0.0, 1.0, 1.0, 1.0, 7.5]) for _ in range(900)], "skew": [rng.paretovariate(0.5) for _ in range(500)], None: [2.5] * 300, "one": [4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in quantiles.percentiles(df, F.col("v"), shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for k, p in shares.items():
            assert got[g][k] == pytest.approx(sorted_ranks(vs, p), rel=1e-12), (g, k)
    median = quantiles.at_ranks(df, F.col("v"), {"m": lambda n: F.floor(n / 2)}, []).first()
    everything = sorted(v for _, v in rows if v is not None)
    assert (median.n, median.m) == (len(everything), everything[len(everything) // 2])
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (None,)], "v double")
    assert quantiles.at_ranks(odd, F.col("v"), {"x": lambda n: F.lit(1), "y": lambda n: F.lit(2)}, []).select("n", "x", F.isnan("y")).first() == (3, float("inf"), True)
    assert quantiles.at_ranks(odd.where("false"), F.col("v"), {"x": lambda n: F.floor(n / 2)}, []).select("x").collect() in ([], [(None,)])


def test_a_bad_sketch_costs_passes_not_results(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 10)
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "OFF", 0.0001)
    values = [random.Random(6).gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.percentiles(df, F.col("v"), {"p": 0.37}, []).first().p
    assert got == pytest.approx(sorted_ranks(values, 0.37), rel=1e-12)


def test_correlations_are_those_of_pairs_by_themselves(spark):
    rng = random.Random(8)
    rows = [(i * 1e6 + rng.random(), rng.choice([None, float(i), 3.0]), rng.random() if i % 3 else None, 0.1, float("nan") if i == 7 else rng.random(), None) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(6)
    for r in reports.correlations(df, list("abcdef")).collect():
        x, y = F.col(r.a), F.col(r.b)
        want = df.where(x.isNotNull() & y.isNotNull()).agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).first()[0]
        if want is None or "d" in (r.a, r.b):
            assert r.r is None or want != want, (r, want)
        else:
            assert (r.r != r.r) if want != want else r.r == pytest.approx(want, abs=1e-9), (r, want)


def test_pages_read_by_their_place(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(4)
    kept = io.pages(df, "k")
    assert kept.n_rows == 1000
    for number, size in ((0, 100), (9, 100), (4, 33), (30, 33), (0, 5000)):
        got = kept.page(number, size)
        assert [r.k for r in got.collect()] == list(range(number * size, min(1000, (number + 1) * size)))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "__r" in plan[plan.index("PushedFilters") :]
    assert [r.k for r in kept.page(77, 100, current=2).collect()] == list(range(200, 300))
    assert io.pages(df.limit(0), "k").page(0).collect() == []


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "comment_id long, c string"), spark.createDataFrame([(2, 0.5), (1, 0.1)], "comment_id long, r double")
    assert sorted(map(tuple, joins.join_one_to_one(a, b).collect())) == [(1, "x", 0.1), (2, "y", 0.5)]
    for left, right in ((a, b.limit(1)), (a.union(a), b.union(b)), (a.union(spark.createDataFrame([(None, "z")], a.schema)), b.union(spark.createDataFrame([(None, 1.0)], b.schema)))):
        with pytest.raises(ValueError, match="comments"):
            joins.join_one_to_one(left, right)


def test_token_batches_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), "x" * rng.randrange(4000)) for i in range(600)]
    got = {r.comment_id: r.batch_no for r in batching.token_batches(spark.createDataFrame(rows, "comment_id long, source string, comment string").repartition(5), "comment_id", "comment", "source").collect()}
    sums, want = {}, {}
    for i, s, c in rows:
        want[i] = int(sums.get(s, 0) // 6480)
        sums[s] = sums.get(s, 0) + max(1, len(c) // 4)
    assert got == want


@pytest.mark.parametrize("steps", [[0, 1, 3_000_000], [500_000, 59_999_999], [1_000_000, 1_000_000, 59_000_000, 60_000_000]])
def test_a_busy_key_is_replayed_in_blocks_like_the_plain_loop(spark, steps):
    """Windows over block borders, runs that end in the first minute of a block, many blocks without a pause."""
    rng = random.Random(len(steps))
    rows, us = [], {1: 599_000_000, None: 0}
    for i in range(6000):
        k = rng.choice([1, 1, 1, None])
        us[k] += rng.choice(steps)
        rows.append((i, k, us[k], rng.choice([100, 9000, 13_000])))
    df = spark.createDataFrame(rows, "call_id long, api_key_id long, us long, tokens_used long").withColumn("ts", F.timestamp_micros("us"))
    got = quota.replay(df, rpm=3, tpm=30_000)
    assert {r.call_id: (r.accepted, r.reason, r.wait_seconds, r.used_requests, r.used_tokens) for r in got.collect()} == replayed(quota.calls_of(df).collect())
    assert got.count() == len(rows)


def test_quota_replay_is_the_plain_loop(spark, sf_dir):
    calls = Tables(spark, sf_dir).api_usage
    got = quota.replay(calls, rpm=3, tpm=30_000).collect()
    want = replayed(quota.calls_of(calls).collect())
    assert {r.call_id: (r.accepted, r.reason, r.wait_seconds, r.used_requests, r.used_tokens) for r in got} == want


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    Tables(spark, sf_dir).api_usage.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).schema, path


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_trend_equals_batch(spark, log):
    schema, path = log
    got = drained(usage.stream_trend(spark.readStream.schema(schema).parquet(path)), "trend", "complete").collect()
    want = usage.usage_trend(spark.read.parquet(path)).where("requests > 0 OR tokens > 0").collect()
    assert {r.bucket: (r.requests, r.tokens) for r in got} == {r.bucket: (r.requests, r.tokens) for r in want}


def as_files(df, path, n):
    """The log in the order of time as several files, which a stream reads one by one, and a call a day later that moves the watermark past all."""
    rows = df.orderBy("ts").collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{i}")
    last = rows[-1].asDict() | {"ts": rows[-1].ts + timedelta(days=1), "call_id": -1}
    df.sparkSession.createDataFrame([tuple(last[c] for c in df.columns)], df.schema).coalesce(1).write.parquet(f"{path}/{n}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def busy_log(spark):
    rng, us, rows = random.Random(12), 0, []
    for i in range(900):
        us += 1_900_000_000 if i % 90 == 45 else rng.choice([0, 0, 1_000, 700_000, 9_000_000, 40_000_000, 61_000_000])
        rows.append((i, us, rng.choice([1, 1, 2]), rng.choice([0, 1]), rng.randrange(500), rng.randrange(9) / 8, 10))
    df = spark.createDataFrame(rows, "call_id long, us long, api_key_id long, requests_made int, tokens_used long, processing_time double, batch_size int")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def test_stream_of_calls_equals_batch_per_call(spark, tmp_path):
    df = busy_log(spark)
    got = drained(live.stream_trailing_calls(as_files(df, str(tmp_path / "log"), 5)), "calls").where("call_id >= 0").collect()
    want = usage.trailing_usage(df).collect()
    assert len(got) == len(want) == 900
    assert {r.call_id: (r.minute_requests, r.minute_tokens, r.minute_batches) for r in got} == {r.call_id: (r.minute_requests, r.minute_tokens, r.minute_batches) for r in want}


def test_stream_of_buckets_equals_batch_with_zeros(spark, tmp_path):
    df = busy_log(spark)
    got = drained(live.stream_full_trend(as_files(df, str(tmp_path / "log"), 4), late="10 minutes"), "buckets").collect()
    want = usage.usage_trend(df).select("bucket", "requests", "tokens", F.round("mean_time", 9).alias("t")).collect()
    assert any(r.requests == 0 for r in want)
    assert [(r.bucket, r.requests, r.tokens, round(r.mean_time, 9)) for r in sorted(got)] == [tuple(r) for r in sorted(want)]


def test_stream_alerts(spark, log):
    schema, path = log
    got = drained(usage.stream_alerts(spark.readStream.schema(schema).parquet(path)), "alerts", "complete")
    assert got.where("batches < 1").count() == 0
    assert got.agg(F.sum("batches")).first()[0] == 6 * spark.read.parquet(path).count()


def test_stream_quota_equals_batch(spark, log):
    schema, path = log
    got = drained(quota.stream_replay(spark.readStream.schema(schema).parquet(path)), "quota", "append").collect()
    want = quota.replay(spark.read.parquet(path)).collect()
    assert {r.call_id: (r.accepted, r.reason) for r in got} == {r.call_id: (r.accepted, r.reason) for r in want}


def test_scratch_folder():
    session = lambda named, set_, master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(getCheckpointDir=lambda: set_, master=master))
    assert scratch.scratch_dir(session("hdfs://a/b", None, "yarn")) == "hdfs://a/b"
    assert scratch.scratch_dir(session(None, "hdfs://c", "yarn")) == "hdfs://c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session(None, None, "spark://host:7077"))
