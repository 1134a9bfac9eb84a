"""Aggregate and quality reports, and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter import constants as K
from voxmeter.functions import nps, responses, text
from voxmeter.operators import quality, reports, scoring
from voxmeter.plans import pipeline
from voxmeter.queries.cleaning import comment_file, n_of, sub
from voxmeter.queries.registry import HELPERS, ORACLES, query, rounded
from voxmeter.queries.scoring import ALIGNMENT, ALIGNMENT_SCORE, CONFIDENCE, DOMINANT, INFER, MEAN, PAIN_CATEGORY, PRIORITY, RISK, SENTIMENT_CONFIDENCE, SPREAD, rated

C = F.col
R = lambda x: f"round({x}, 6)"
MEANS = " UNION ALL ".join(f"SELECT {i} AS i, '{e}' AS emotion, avg({e}) AS mean, max({e}) AS top, count_if({e} > 0.5) AS high FROM analysis" for i, e in enumerate(K.EMOTIONS))
HELPERS["emotion_means"] = MEANS
BINS = [("Bajo", "churn_risk > 0 AND churn_risk <= 0.3"), ("Medio", "churn_risk > 0.3 AND churn_risk <= 0.7"), ("Alto", "churn_risk > 0.7 AND churn_risk <= 1")]


def bins_sql(whole: str) -> str:
    return " UNION ALL ".join(f"SELECT '{b}' AS bin, count_if({w}) AS n, round(count_if({w}) * 100.0 / {whole}, 6) AS percentage FROM analysis" for b, w in BINS)


@query(f"SELECT emotion, {R('mean * 100')} AS percentage FROM emotion_means")
def g1_emotion_distribution(t):
    return rounded(reports.emotion_distribution(t.analysis))


@query(f"SELECT emotion, {R('mean * 100')} AS percentage FROM emotion_means ORDER BY mean DESC, i LIMIT 3")
def g1_top_emotions(t):
    return rounded(reports.emotion_distribution(t.analysis, 3))


@query("SELECT upper(emotion[1]) || emotion[2:] AS emotion, round_even(mean, 3) AS mean, round_even(top, 3) AS max, high AS high_cases, round_even(mean * 100, 1) AS percentage FROM emotion_means")
def g2_emotion_summary(t):
    return reports.emotion_summary(t.analysis)


@query(f"SELECT nps_category, count(*) AS n, {R('count(*) * 100.0 / (SELECT count(*) FROM rated)')} AS percentage FROM rated GROUP BY nps_category")
def g3_nps_categories(t):
    return rounded(reports.value_shares(rated(t), "nps_category"))


HELPERS["nps_counts"] = "SELECT count(*) AS total_responses, count_if(nps_category <> 'unknown') AS valid_responses, count_if(nps_category = 'promoter') AS promoter, count_if(nps_category = 'passive') AS passive, count_if(nps_category = 'detractor') AS detractor, count_if(nps_category = 'unknown') AS unknown FROM rated"
SCORE = "(promoter - detractor) * 100.0::DOUBLE / valid_responses"
WORD = lambda s: f"CASE WHEN {s} >= 50 THEN 'Excellent' WHEN {s} >= 0 THEN 'Good' WHEN {s} >= -50 THEN 'Needs Improvement' ELSE 'Critical' END"


@query(f"SELECT round_even({SCORE}, 1) AS nps_score, {WORD(SCORE)} AS interpretation, *, " + ", ".join(f"round_even({k} * 100.0::DOUBLE / valid_responses, 1) AS {k}_pct" for k in ("promoter", "passive", "detractor")) + ", round_even(unknown * 100.0::DOUBLE / total_responses, 1) AS unknown_pct FROM nps_counts")
def g4_nps_score(t):
    return reports.nps_score(rated(t))


@query("SELECT p AS promoters, d AS detractors, n - p - d AS passives, round((p - d) * 100.0 / n, 6) AS nps_score, CASE WHEN (p - d) * 100.0 / n > 50 THEN 'Excelente' WHEN (p - d) * 100.0 / n > 0 THEN 'Bueno' ELSE 'Crítico' END AS interpretation FROM (SELECT count(*) AS n, count_if(nps >= 9) AS p, count_if(nps <= 6) AS d FROM analysis)")
def g5_raw_nps_score(t):
    return rounded(reports.raw_nps_score(t.analysis))


@query(bins_sql("count(*)"))
def g6_churn_bins(t):
    return rounded(reports.churn_bins(t.analysis))


@query(bins_sql("count_if(churn_risk > 0 AND churn_risk <= 1)"))
def g6_churn_bins_of_binned(t):
    return rounded(reports.churn_bins(t.analysis, "binned"))


@query("SELECT round_even(count_if(churn_risk < 0.3) * 100.0::DOUBLE / count(churn_risk), 1) AS low_pct, round_even(count_if(churn_risk >= 0.3 AND churn_risk < 0.7) * 100.0::DOUBLE / count(churn_risk), 1) AS medium_pct, round_even(count_if(churn_risk >= 0.7) * 100.0::DOUBLE / count(churn_risk), 1) AS high_pct, round_even(avg(churn_risk), 3) AS mean, round_even(quantile_disc(churn_risk, 0.5 ORDER BY churn_risk DESC), 3) AS median, round_even(min(churn_risk), 3) AS min, round_even(max(churn_risk), 3) AS max FROM analysis".replace("quantile_disc(churn_risk, 0.5 ORDER BY churn_risk DESC)", "(percentile_disc(0.5) WITHIN GROUP (ORDER BY churn_risk DESC))"))
def g7_churn_distribution(t):
    return reports.churn_distribution(t.analysis)


@query("SELECT round(avg(churn_risk), 6) AS mean_churn, count_if(churn_risk > 0.7) AS high_count, round(count_if(churn_risk > 0.7) * 100.0 / count(*), 6) AS high_pct FROM analysis")
def g8_churn_headlines(t):
    return rounded(reports.churn_headlines(t.analysis))


NUMBERS = [*K.EMOTIONS, "nps", "churn_risk"]
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
HELPERS["correlated"] = "SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in PAIRS) + " FROM analysis"


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan({a}__{b}) THEN NULL ELSE {a}__{b} END, 6) AS r FROM correlated" for a, b in PAIRS))
def g9_correlations(t):
    return rounded(reports.correlations(t.analysis, NUMBERS))


@query("SELECT pain_point, count(*) AS n FROM points GROUP BY pain_point ORDER BY n DESC, min((comment_id, pos)) LIMIT 10")
def g10_top_pain_points(t):
    return reports.top_pain_points(t.analysed)


HELPERS["pains"] = f"SELECT *, {PAIN_CATEGORY('pain_point')} AS category FROM points"
HELPERS["pain_counts"] = "SELECT category, count(*) AS n, (SELECT count(*) FROM pains) AS total FROM pains GROUP BY category"
ORD = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(K.PAIN_CATEGORIES)) + " ELSE 6 END"


@query(f"SELECT category, n, round_even(n * 100.0::DOUBLE / total, 1) AS percentage, total, CAST({ORD} AS INT) AS ord, (SELECT string_agg(pain_point, '|' ORDER BY comment_id, pos) FROM (SELECT * FROM pains p WHERE p.category = c.category ORDER BY comment_id, pos LIMIT 3)) AS examples FROM pain_counts c")
def g11_pain_insights(t):
    return reports.pain_insights(t.analysed)


@query(f"SELECT category AS most_affected, total FROM pain_counts ORDER BY n DESC, {ORD} LIMIT 1")
def g11_most_affected(t):
    return reports.most_affected(reports.pain_insights(t.analysed))


HELPERS["aligned"] = f"SELECT *, {ALIGNMENT} AS alignment, {ALIGNMENT_SCORE} AS alignment_score FROM rated"


@query("""SELECT total_analyzed, promoters, passives, detractors, passive_promotion, detractor_recovery, concat_ws('|', CASE WHEN detractors / total_analyzed > 0.3 THEN 'Address detractor concerns - over 30% detractor rate' END, CASE WHEN passives / total_analyzed > 0.5 THEN 'Focus on passive engagement - large neutral segment' END) AS priority_actions FROM (
SELECT count(*) AS total_analyzed, count_if(nps_category = 'promoter') AS promoters, count_if(nps_category = 'passive') AS passives, count_if(nps_category = 'detractor') AS detractors, count_if(nps_category = 'passive' AND alignment = 'misaligned') AS passive_promotion, count_if(nps_category = 'detractor' AND round(alignment_score, 9) < 0.7) AS detractor_recovery FROM aligned)""")
def g12_nps_opportunities(t):
    r = rated(t)
    return reports.nps_opportunities(r.withColumns({"alignment": nps.alignment(C("nps_category"), C("sentiment")), "alignment_score": F.round(nps.alignment_score(C("nps_category")), 9)}))


@query("SELECT (SELECT count(*) FROM analysis) AS total, 16 AS n_emotions, (SELECT round(avg(nps), 6) FROM analysis) AS mean_nps, (SELECT count_if(churn_risk > 0.7) FROM analysis) AS high_churn, (SELECT string_agg(emotion, ',' ORDER BY mean DESC, i) FROM (SELECT * FROM emotion_means ORDER BY mean DESC, i LIMIT 5)) AS top_emotions")
def g13_run_summary(t):
    return rounded(reports.run_summary(t.analysis))


@query("SELECT 'emotion' AS metric, emotion AS name, round_even(mean * 100, 2) AS value FROM emotion_means UNION ALL SELECT 'nps', nps_category, round(count(*) * 100.0 / (SELECT count(*) FROM rated), 6) FROM rated GROUP BY nps_category UNION ALL SELECT 'churn', bin, percentage FROM (" + bins_sql("count_if(churn_risk > 0 AND churn_risk <= 1)") + ")")
def g14_run_metrics(t):
    return rounded(reports.run_metrics(rated(t)))


@query("SELECT (SELECT count(*) FROM comments) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM comments) - count(*) AS rows_removed, round_even(((SELECT count(*) FROM comments) - count(*)) * 100.0::DOUBLE / (SELECT count(*) FROM comments), 2) AS removed_pct, min(length(comment)) AS min_length, max(length(comment)) AS max_length, round_even(avg(length(comment)), 1) AS mean_length, count_if(nota IS NULL) AS nulls_nota, count_if(comment IS NULL) AS nulls_comment, count_if(nps IS NULL) AS nulls_nps FROM cleaned")
def g15_cleaning_report(t):
    return quality.cleaning_report(t.comments, pipeline.clean(t.comments).select("nota", "comment", "nps"))


HELPERS["nps_checks"] = "SELECT count(*) AS total, count_if(nps IS NULL) AS missing, count_if(nps < 0 OR nps > 10) AS out_of_range, count(DISTINCT nps) AS distinct_values FROM analysis"


NPS_CHECK = "SELECT *, round_even(missing * 100.0::DOUBLE / total, 1) AS missing_pct, CASE WHEN missing * 2 > total THEN 'error' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS missing_status, missing = total AS all_missing, CASE WHEN out_of_range > 0 THEN 'error' ELSE 'ok' END AS range_status, CASE WHEN missing < total AND distinct_values < 3 THEN 'warning' ELSE 'ok' END AS diversity_status FROM nps_checks"


@query(NPS_CHECK)
def g16_validate_nps(t):
    return quality.validate_nps(t.analysis)


RATING_CHECK = "SELECT total, missing, negative, round_even(missing * 100.0::DOUBLE / total, 1) AS missing_pct, CASE WHEN missing * 10 > total * 3 THEN 'warning' ELSE 'ok' END AS missing_status, CASE WHEN negative > 0 THEN 'warning' ELSE 'ok' END AS range_status FROM (SELECT count(*) AS total, count_if(nota IS NULL) AS missing, count_if(nota < 0) AS negative FROM comments)"


@query(RATING_CHECK)
def g17_validate_rating(t):
    return quality.validate_rating(t.comments)


COMMENT_CHECK = "SELECT total, missing, round_even(missing * 100.0::DOUBLE / total, 1) AS missing_pct, short, round_even(short * 100.0::DOUBLE / (total - missing), 1) AS short_pct, long, duplicates, round_even(duplicates * 100.0::DOUBLE / (total - missing), 1) AS duplicate_pct, CASE WHEN missing * 10 > total THEN 'error' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS missing_status, CASE WHEN duplicates * 20 > total - missing THEN 'many' WHEN duplicates > 0 THEN 'some' ELSE 'none' END AS duplicate_status FROM (SELECT count(*) AS total, count_if(comment IS NULL) AS missing, count_if(length(comment) < 5) AS short, count_if(length(comment) > 1000) AS long, count(comment) - count(DISTINCT comment) AS duplicates FROM comments)"


@query(COMMENT_CHECK)
def g18_validate_comments(t):
    return quality.validate_comments(t.comments)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max, count(DISTINCT {c}) AS distinct_values, count_if({c} IS NULL) AS nulls FROM analysis" for c in ("nps", "churn_risk", "alegria")))
def g19_describe(t):
    return rounded(quality.describe(t.analysis, ["nps", "churn_risk", "alegria"]))


@query("SELECT nps, count(*) AS n FROM analysis WHERE nps IS NOT NULL GROUP BY nps")
def g19_value_counts(t):
    return quality.value_counts(t.analysis, "nps")


@query(f"SELECT count(comment) AS total_comments, round_even(avg(length(comment)), 1) AS mean_length, min(length(comment)) AS min_length, max(length(comment)) AS max_length, count_if(trim(comment) = '') AS empty_comments, CASE WHEN avg(CAST({n_of('lower(comment)', K.SPANISH_INDICATORS)} >= 2 AS INT)) > 0.7 THEN 'Spanish' ELSE 'Mixed/Other' END AS language FROM comments")
def g19_d14_comment_profile(t):
    return quality.comment_profile(t.comments)


@query("SELECT n AS total_rows, o AS original_valid, n - o AS needing_inference, f AS final_valid, round(o * 100.0 / n, 6) AS before_pct, round(f * 100.0 / n, 6) AS after_pct, round(f * 100.0 / n - o * 100.0 / n, 6) AS improvement_points FROM (SELECT count(*) AS n, count(nps) AS o, count(*) AS f FROM analysis)")
def g20_inference_stats(t):
    a = t.analysis.withColumn("final", nps.filled(C("nps"), C("sentiment"), C("churn_risk")))
    return rounded(quality.inference_stats(a, "nps", "final"))


HELPERS["confident"] = f"SELECT round({CONFIDENCE}, 6) AS c, {INFER} AS v FROM analysis"
HELPERS["confident_counts"] = "SELECT count(*) AS n, count_if(c > 0.75) AS high, count_if(c BETWEEN 0.5 AND 0.75) AS medium, avg(c) AS q, stddev_pop(v) AS s FROM confident"
RATING = "CASE WHEN q > 0.7 AND high / n > 0.6 THEN 'EXCELLENT' WHEN q > 0.5 AND (high + medium) / n > 0.7 THEN 'GOOD' ELSE 'ACCEPTABLE' END"


@query(f"SELECT n, high, medium, n - high - medium AS low, round(q, 6) AS quality_score, round(s, 6) AS nps_std, {RATING} AS rating, concat_ws('|', CASE WHEN q < 0.5 THEN 'Consider improving emotion analysis prompt for clearer emotional signals' END, CASE WHEN {RATING} = 'ACCEPTABLE' THEN 'Review emotion weights - may need calibration for your domain' END) AS recommendations FROM confident_counts")
def g21_inference_quality(t):
    a = t.analysis.select(F.round(nps.inference_confidence(C("sentiment"), C("churn_risk")), 6).alias("c"), nps.infer(C("sentiment"), C("churn_risk")).alias("v"))
    return rounded(quality.inference_quality(a, "c", "v"))


@query(f"SELECT count(*) AS total, count_if(comment <> b) AS changed, round(count_if(comment <> b) * 100.0 / count(*), 6) AS changed_pct, round(avg(length(comment)), 6) AS mean_before, round(avg(length(b)), 6) AS mean_after, round(avg(length(b)) - avg(length(comment)), 6) AS delta FROM (SELECT comment, {sub('comment', r'\s+', ' ')} AS b FROM comments WHERE comment IS NOT NULL)")
def g22_normalization_summary(t):
    c = t.comments.where("comment IS NOT NULL").withColumn("b", text.normalize_space(C("comment")))
    return rounded(quality.normalization_summary(c, "comment", "b"))


@query("""SELECT CASE WHEN n > 100 THEN 'good' WHEN n > 0 THEN 'minimal' ELSE 'error' END AS ingestion, CASE WHEN r > 80 THEN 'success' WHEN r > 60 THEN 'warning' ELSE 'error' END AS retention, CASE WHEN p > 95 THEN 'success' WHEN p > 80 THEN 'warning' ELSE 'error' END AS parsing, CASE WHEN q > 0.7 THEN 'success' WHEN q > 0.5 THEN 'warning' ELSE 'error' END AS inference, 'warning' AS completion
FROM (SELECT (SELECT count(*) FROM comments) AS n, (SELECT count(*) FROM cleaned) * 100.0 / (SELECT count(*) FROM comments) AS r, (SELECT avg(CAST(item IS NOT NULL AS INT)) * 100 FROM items) AS p, (SELECT q FROM confident_counts) AS q)""")
def g29_stage_grades(t):
    n = t.comments.agg(F.count("*").alias("n"))
    kept = pipeline.clean(t.comments).agg(F.count("*").alias("kept"))
    parsed = responses.response_rows(t.llm_raw).agg((F.avg(C("item").isNotNull().cast("int")) * 100).alias("p"))
    sure = t.analysis.agg(F.avg(F.round(nps.inference_confidence(C("sentiment"), C("churn_risk")), 6)).alias("q"))
    one = n.crossJoin(kept).crossJoin(parsed).crossJoin(sure)  # four single rows
    return one.select(quality.ingestion_grade(C("n")).alias("ingestion"), quality.grade(C("kept") * 100 / C("n"), 80, 60).alias("retention"), quality.grade(C("p"), 95, 80).alias("parsing"), quality.grade(C("q"), 0.7, 0.5).alias("inference"), quality.completion_grade(F.lit(False), F.lit(True), F.lit(True)).alias("completion"))


@query("SELECT round(avg(nps), 6) AS mean_nps, round(avg(length(comment)), 6) AS mean_length, round(avg(nota), 6) AS mean_rating FROM cleaned")
def g30_preview_stats(t):
    return rounded(quality.preview_stats(pipeline.clean(t.comments)))


@query("SELECT bin, round(n * 100.0 / sum(n) OVER (), 6) AS share FROM (" + bins_sql("count(*)") + ")")
def g31_known_shares(t):
    return rounded(reports.churn_bins(t.analysis, "binned").select("bin", F.col("percentage").alias("share")))


@query("SELECT total, missing FROM nps_checks")
def p2_validate(t):
    return pipeline.validate(t.analysis.join(t.comments.select("comment_id", "nota", "comment"), "comment_id"), max_rows=None)["nps"].select("total", "missing")


HELPERS["cleaned_checks"] = HELPERS["nps_checks"].replace("FROM analysis", "FROM cleaned")


def checks(t):
    """The reports of the cleaned comments; the size is checked without an upper limit."""
    return pipeline.validate(pipeline.clean(t.comments), max_rows=None)


@query(NPS_CHECK.replace("FROM nps_checks", "FROM cleaned_checks"))
def p2_validate_nps(t):
    return checks(t)["nps"]


@query(RATING_CHECK.replace("FROM comments", "FROM cleaned"))
def p2_validate_rating(t):
    return checks(t)["rating"]


@query(COMMENT_CHECK.replace("FROM comments", "FROM cleaned"))
def p2_validate_comments(t):
    return checks(t)["comment"]


HELPERS["run_counts"] = HELPERS["nps_counts"].replace("FROM rated", "FROM enriched")


@query(f"SELECT round_even({SCORE}, 1) AS nps_score, {WORD(SCORE)} AS interpretation, total_responses, valid_responses, promoter, passive, detractor FROM run_counts")
def nps_score_pipeline(t):
    e = pipeline.enrich(pipeline.analyze(pipeline.clean(t.comments)))
    return reports.nps_score(e).select("nps_score", "interpretation", "total_responses", "valid_responses", "promoter", "passive", "detractor")


HELPERS["run_scored"] = HELPERS["scored"].replace("FROM cleaned", "FROM normal")
HELPERS["run_lexicon"] = HELPERS["lexicon"].replace("FROM scored", "FROM run_scored")
HELPERS["run_enriched"] = HELPERS["enriched"].replace("FROM lexicon", "FROM run_lexicon")
RUN = f"""SELECT comment_id, lang, source, nota, comment, nps, nps_was_inferred, nps_category, {', '.join(K.EMOTIONS)}, churn_risk, sentiment, {', '.join(f'round({MEAN(v)}, 6) AS emo_category_{k}' for k, v in K.CATEGORIES.items())},
 CAST(n AS INT) AS pain_point_count, CASE WHEN n = 1 THEN 'mock_pain_point' ELSE '' END AS pain_points_text, {DOMINANT} AS dominant_emotion, round({SPREAD}, 6) AS emotion_intensity, round({SENTIMENT_CONFIDENCE}, 6) AS sentiment_confidence, {RISK} AS customer_risk_level, {PRIORITY} AS retention_priority,
 (row_number() OVER (ORDER BY comment_id) - 1) // 80 AS batch_id, CAST((row_number() OVER (ORDER BY comment_id) - 1) % 80 AS INT) AS pos FROM run_enriched"""


def whole_run(t, scorer=None, rows=None):
    return pipeline.run_pipeline(t.spark, comment_file(t, rows), "comment_id", scorer, batch_size=80)


@query(RUN)
def p6_run_pipeline(t):
    """The whole chain, from a file with other column names to enriched rows."""
    # A run keeps its file's order, and Spark reads a table's files by size: the file that the SQL numbers is one in the order of ids.
    out = whole_run(t, rows=t.comments.orderBy("comment_id"))["results"].drop("nps_raw", "pain_points").withColumn("comment_id", C("comment_id").cast("long"))
    return rounded(out, 6, "emotion_intensity", "sentiment_confidence", *[f"emo_category_{k}" for k in K.CATEGORIES])


@query(f"SELECT comment_id, sentiment, churn_risk, alegria, enojo, nps, {RISK} AS customer_risk_level FROM run_enriched")
def p6_run_with_scorer(t):
    """The same with a scorer of the user's."""
    out = whole_run(t, scoring.lexicon_scorer)["results"]
    return out.select(C("comment_id").cast("long"), "sentiment", "churn_risk", "alegria", "enojo", "nps", "customer_risk_level")


RUN_MEANS = " UNION ALL ".join(f"SELECT {i} AS i, '{e}' AS emotion, avg({e}) AS mean FROM run_enriched" for i, e in enumerate(K.EMOTIONS))
HELPERS["run_means"] = RUN_MEANS


@query("SELECT count(*) AS total, 16 AS n_emotions, round(avg(nps), 6) AS mean_nps, count_if(churn_risk > 0.7) AS high_churn, (SELECT string_agg(emotion, ',' ORDER BY mean DESC, i) FROM (SELECT emotion, round(mean, 9) AS mean, i FROM run_means ORDER BY 2 DESC, i LIMIT 5)) AS top_emotions FROM run_enriched")
def p6_run_summary(t):
    return rounded(whole_run(t)["summary"])


@query("SELECT 'emotion' AS metric, emotion AS name, round(mean * 100, 2) AS value FROM run_means UNION ALL SELECT 'nps', nps_category, round(count(*) * 100.0 / (SELECT count(*) FROM run_enriched), 6) FROM run_enriched GROUP BY nps_category UNION ALL SELECT 'churn', bin, percentage FROM (" + bins_sql("count_if(churn_risk > 0 AND churn_risk <= 1)").replace("FROM analysis", "FROM run_enriched") + ")")
def p6_run_metrics(t):
    return rounded(whole_run(t)["metrics"])


@query("SELECT nps_category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM rated), 6) AS percentage FROM rated GROUP BY nps_category")
def p7_report_bundle(t):
    return rounded(reports.report_bundle(rated(t))["Resumen_NPS"])


@query(f"SELECT comment_id, nps, {', '.join(K.EMOTIONS)}, churn_risk, sentiment, nps_category, CAST(n AS INT) AS n, replace(pain_points_csv, '|', ', ') AS pain_points FROM rated")
def p7_analisis_completo(t):
    return reports.report_bundle(rated(t).withColumn("_internal", F.lit(1)))["Analisis_Completo"].withColumn("pain_points", F.array_join("pain_points", ", "))


def p7_resumen_emociones(t):
    return reports.report_bundle(rated(t))["Resumen_Emociones"]


def p7_resumen_analisis(t):
    return rounded(reports.report_bundle(rated(t))["Resumen_Analisis"])


@query(bins_sql("count(churn_risk)"))
def p7_resumen_churn(t):
    return rounded(reports.report_bundle(rated(t))["Resumen_Churn"])


# The same rows as the reports by themselves.
for dataset, report in ((p7_resumen_emociones, "g2_emotion_summary"), (p7_resumen_analisis, "g13_run_summary")):
    query()(dataset)
    ORACLES[dataset.__name__] = ORACLES[report]
