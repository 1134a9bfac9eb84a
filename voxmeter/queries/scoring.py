"""Emotion, NPS, churn and pain-point functions, response parsing, joins, batches, and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter import constants as K
from voxmeter.functions import churn, emotion, nps, pain, responses
from voxmeter.operators import batching, joins, scoring
from voxmeter.plans import pipeline
from voxmeter.queries.cleaning import BAD, CHURN, GOOD, any_of
from voxmeter.queries.registry import HELPERS, query, rounded

C = F.col
MEAN = lambda names: f"(({' + '.join(names)}) / {len(names)})"
BEST = f"greatest({', '.join(K.EMOTIONS)})"
SPREAD = "sqrt((" + " + ".join(f"pow({e} - {MEAN(K.EMOTIONS)}, 2)" for e in K.EMOTIONS) + ") / 16)"
DOMINANT = "CASE " + " ".join(f"WHEN {e} = {BEST} THEN '{e}'" for e in K.EMOTIONS) + " ELSE 'indiferencia' END"
CLAMP = lambda x, a=0.0, b=1.0: f"greatest({a}, least({b}, {x}))"
CATEGORY = lambda x: f"CASE WHEN trunc({x}) BETWEEN 0 AND 6 THEN 'detractor' WHEN trunc({x}) BETWEEN 7 AND 8 THEN 'passive' WHEN trunc({x}) BETWEEN 9 AND 10 THEN 'promoter' ELSE 'unknown' END"
INFER = f"round_even({CLAMP('5 + ((' + ' + '.join(f'{e} * {w}::DOUBLE' for e, w in K.NPS_WEIGHTS.items()) + f') / {sum(abs(w) for w in K.NPS_WEIGHTS.values())}::DOUBLE' + ' + CASE sentiment WHEN $$positive$$ THEN 0.4::DOUBLE WHEN $$negative$$ THEN -0.4::DOUBLE ELSE 0.0::DOUBLE END - (coalesce(churn_risk, 0.5::DOUBLE) - 0.5::DOUBLE) * 0.6::DOUBLE) * 3.33::DOUBLE', '0.0::DOUBLE', '10.0::DOUBLE')}, 1)"
CONFIDENCE = CLAMP(f"({BEST} - {SPREAD}) * 0.6 + CASE WHEN sentiment <> 'neutral' THEN 0.2 ELSE 0.0 END + abs(coalesce(churn_risk, 0.5) - 0.5) * 0.4", 0.1, 0.95)
EXPECTED = "CASE nps_category WHEN 'detractor' THEN 'negative' WHEN 'promoter' THEN 'positive' ELSE 'neutral' END"
ALIGNMENT = f"CASE WHEN nps_category = 'unknown' THEN 'unknown' WHEN sentiment = {EXPECTED} THEN 'aligned' ELSE 'misaligned' END"
ALIGNMENT_SCORE = f"CASE nps_category WHEN 'promoter' THEN least(1.0, {MEAN(K.PROMOTER_EMOTIONS)} + 0.3) WHEN 'detractor' THEN least(1.0, {MEAN(K.DETRACTOR_EMOTIONS)} + 0.2) WHEN 'passive' THEN 1 - greatest(0.0, {BEST} - 0.6) ELSE 0.0 END"
RISK_CATEGORY = lambda x: f"CASE WHEN {x} < 0.3 THEN 'low' WHEN {x} < 0.7 THEN 'medium' ELSE 'high' END"
PAIN_CATEGORY = lambda x: "CASE " + " ".join(f"WHEN {any_of(x, ks)} THEN '{c}'" for c, ks in K.PAIN_CATEGORIES.items()) + " ELSE 'otros' END"
RISK = "CASE WHEN nps_category = 'detractor' AND churn_risk > 0.7 THEN 'CRITICAL' WHEN nps_category = 'detractor' OR churn_risk > 0.6 THEN 'HIGH' WHEN nps_category = 'passive' AND n > 2 THEN 'MEDIUM' WHEN nps_category = 'passive' OR churn_risk > 0.4 THEN 'LOW' ELSE 'MINIMAL' END"
PRIORITY = "CAST(greatest(1, least(10, CASE nps_category WHEN 'detractor' THEN 8 WHEN 'passive' THEN 5 WHEN 'promoter' THEN 2 ELSE 6 END + CAST(floor(churn_risk * 3) AS INT) + least(2, n))) AS INT)"

HELPERS["rated"] = f"SELECT *, CASE WHEN pain_points_csv = '' THEN 0 ELSE len(string_split(pain_points_csv, '|')) END AS n, {CATEGORY('nps')} AS nps_category FROM analysis"
HELPERS["points"] = "SELECT comment_id, churn_risk, unnest(string_split(pain_points_csv, '|')) AS pain_point, unnest(range(len(string_split(pain_points_csv, '|')))) AS pos FROM analysis WHERE pain_points_csv <> ''"


def rated(t):
    return t.analysed.withColumns({"nps_category": nps.category(C("nps")), "n": F.size("pain_points")})


@query("SELECT comment_id, " + ", ".join(f"{e}" for e in K.EMOTIONS) + " FROM analysis")
def e1_b5_extract_emotions(t):
    a = t.analysis
    packed = a.select("comment_id", F.create_map(*[x for e in K.EMOTIONS for x in (F.lit(e), C(e).cast("string"))]).alias("emotions"))
    return emotion.extract(packed, "emotions").drop("emotions")


@query("SELECT comment_id, " + ", ".join(f"{MEAN(v)} AS emo_category_{k}" for k, v in K.CATEGORIES.items()) + " FROM analysis")
def e2_category_means(t):
    return emotion.with_categories(t.analysis).select("comment_id", *[f"emo_category_{k}" for k in K.CATEGORIES])


@query("SELECT comment_id, string_agg(emotion, ',' ORDER BY score DESC, i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY score DESC, i) AS r FROM (" + " UNION ALL ".join(f"SELECT comment_id, {i} AS i, '{e}' AS emotion, {e} AS score FROM analysis" for i, e in enumerate(K.EMOTIONS)) + ")) WHERE r <= 3 GROUP BY comment_id")
def e3_top_emotions(t):
    return t.analysis.select("comment_id", F.array_join(F.transform(emotion.dominant_n(3), lambda s: s["emotion"]), ",").alias("top"))


@query("SELECT comment_id, comment_id % 10 <> 0 AS valid FROM analysis")
def e4_valid_scores(t):
    bad = F.when(C("comment_id") % 10 == 0, F.lit("1.5")).otherwise(C("miedo").cast("string"))
    m = F.create_map(*[x for e in K.EMOTIONS for x in (F.lit(e), bad if e == "miedo" else C(e).cast("string"))])
    return t.analysis.select("comment_id", emotion.valid_scores(m).alias("valid"))


@query(f"SELECT comment_id, {DOMINANT} AS dominant_emotion FROM analysis")
def e5_dominant_emotion(t):
    return t.analysis.select("comment_id", emotion.dominant().alias("dominant_emotion"))


@query(f"SELECT comment_id, round({SPREAD}, 6) AS emotion_intensity FROM analysis")
def e6_emotion_intensity(t):
    return t.analysis.select("comment_id", F.round(emotion.spread(), 6).alias("emotion_intensity"))


P, N = MEAN(K.CATEGORIES["positivas"]), MEAN(K.CATEGORIES["negativas"])
SENTIMENT_CONFIDENCE = CLAMP(f"CASE sentiment WHEN 'positive' THEN {P} + greatest(0.0, {P} - {N}) * 0.5 WHEN 'negative' THEN {N} + greatest(0.0, {N} - {P}) * 0.5 ELSE (1 - abs({P} - {N})) * 0.8 END", 0.05, 0.95)


@query(f"SELECT comment_id, round({SENTIMENT_CONFIDENCE}, 6) AS sentiment_confidence FROM analysis")
def e7_sentiment_confidence(t):
    return t.analysis.select("comment_id", F.round(emotion.sentiment_confidence(C("sentiment")), 6).alias("sentiment_confidence"))


@query("SELECT comment_id, greatest(0.0, least(1.0, coalesce(TRY_CAST(nps AS DOUBLE), 0.5))) AS base FROM analysis")
def e8_churn_base(t):
    return t.analysis.select("comment_id", churn.base(C("nps")).alias("base"))


CONTEXT = CLAMP(f"churn_risk * 0.6 + {CHURN} * 0.3 + CASE WHEN a.nps IS NULL THEN 0.0 WHEN a.nps <= 6 THEN 0.2 WHEN a.nps <= 8 THEN 0.1 ELSE -0.1 END * 0.1")


@query(f"SELECT comment_id, round(CAST(p AS DOUBLE), 6) AS probability, {RISK_CATEGORY('round(CAST(p AS DOUBLE), 9)')} AS category FROM (SELECT a.comment_id, {CONTEXT} AS p FROM analysis a JOIN comments c ON a.comment_id = c.comment_id)")
def e9_churn_with_context(t):
    s = churn.with_context(C("churn_risk"), C("comment"), C("nps"))
    joined = t.analysis.join(t.comments.select("comment_id", "comment"), "comment_id").select("comment_id", s["probability"].alias("p"))
    return joined.select("comment_id", F.round("p", 6).alias("probability"), churn.category(F.round("p", 9)).alias("category"))


@query("SELECT comment_id, CAST(CASE WHEN nps IS NULL THEN 0.0 WHEN nps <= 6 THEN 0.2 WHEN nps <= 8 THEN 0.1 ELSE -0.1 END AS DOUBLE) AS risk FROM analysis")
def e10_nps_risk(t):
    return t.analysis.select("comment_id", churn.nps_risk(C("nps")).alias("risk"))


@query(f"SELECT comment_id, {RISK_CATEGORY('churn_risk')} AS category FROM analysis")
def e11_risk_category(t):
    return t.analysis.select("comment_id", churn.category(C("churn_risk")).alias("category"))


FACTORS = [
    (any_of("lower(comment)", K.CHURN_HIGH), "explicit_cancellation_intent"),
    (any_of("lower(comment)", K.CHURN_MEDIUM), "dissatisfaction_indicators"),
    ("sentiment = 'negative'", "negative_sentiment"),
    ("(" + " + ".join(f"CAST({e} > 0.6 AS INT)" for e in K.RISK_NEGATIVE) + ") >= 2", "high_negative_emotions"),
    (f"{MEAN(K.RISK_POSITIVE)} < 0.2", "low_positive_emotions"),
    ("a.n >= 3", "multiple_pain_points"),
]


@query("SELECT a.comment_id, CASE WHEN coalesce(comment, '') = '' THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in FACTORS) + ") END AS factors FROM rated a JOIN comments c ON a.comment_id = c.comment_id")
def e12_risk_factors(t):
    joined = rated(t).join(t.comments.select("comment_id", "comment"), "comment_id")
    return joined.select("comment_id", F.array_join(churn.factors(C("comment"), C("sentiment"), C("n")), ",").alias("factors"))


@query("SELECT comment_id, lower(trim(pain_points_csv)) AS points FROM analysis")
def e13_clean_pain_points(t):
    messy = F.transform("pain_points", lambda x: F.concat(F.lit("  "), F.upper(x), F.lit(" ")))
    return t.analysed.select("comment_id", F.array_join(pain.clean(F.concat(messy, F.array(F.lit(" "), F.lit(None)))), "|").alias("points"))


@query(f"SELECT comment_id, category, string_agg(pain_point, '|' ORDER BY pos) AS points FROM (SELECT comment_id, pos, pain_point, {PAIN_CATEGORY('pain_point')} AS category FROM points) GROUP BY comment_id, category")
def e14_categorize_pain_points(t):
    return t.analysed.select("comment_id", F.explode(pain.categorized(C("pain_points"))).alias("category", "p")).select("comment_id", "category", F.array_join("p", "|").alias("points"))


@query("SELECT comment_id, CASE WHEN n = 0 THEN 'none' WHEN churn_risk > 0.7 OR n >= 3 THEN 'high' WHEN churn_risk > 0.4 OR n >= 2 THEN 'medium' ELSE 'low' END AS severity FROM rated")
def e15_pain_severity(t):
    return rated(t).select("comment_id", pain.severity(C("n"), C("churn_risk")).alias("severity"))


@query(f"SELECT comment_id, {CATEGORY('nps + 0.9')} AS nps_category FROM analysis")
def e16_nps_category(t):
    return t.analysis.select("comment_id", nps.category(C("nps") + 0.9).alias("nps_category"))


@query(f"SELECT comment_id, nps_category, {EXPECTED} AS expected, sentiment AS actual, {ALIGNMENT} AS alignment FROM rated")
def e17_alignment(t):
    c = C("nps_category")
    return rated(t).select("comment_id", c, nps.expected_sentiment(c).alias("expected"), C("sentiment").alias("actual"), nps.alignment(c, C("sentiment")).alias("alignment"))


@query(f"SELECT comment_id, round({ALIGNMENT_SCORE}, 6) AS alignment_score FROM rated")
def e18_alignment_score(t):
    return rated(t).select("comment_id", F.round(nps.alignment_score(C("nps_category")), 6).alias("alignment_score"))


ALIGNED = f"sentiment = {EXPECTED}"


@query(f"""SELECT comment_id, CASE WHEN nps_category = 'unknown' THEN '' ELSE concat_ws('|',
 CASE nps_category WHEN 'detractor' THEN 'Customer is a detractor - high churn risk' WHEN 'promoter' THEN 'Customer is a promoter - potential advocate' ELSE 'Customer is passive - opportunity for improvement' END,
 CASE WHEN nps_category = 'detractor' AND {ALIGNED} THEN 'Sentiment aligns with NPS - genuine dissatisfaction' WHEN nps_category = 'detractor' THEN 'Sentiment misalignment - investigate comment context'
  WHEN nps_category = 'promoter' AND {ALIGNED} THEN 'Strong positive sentiment supports promoter status' WHEN nps_category = 'promoter' THEN 'Unexpected negative sentiment despite high NPS - investigate'
  WHEN {ALIGNED} THEN 'Neutral sentiment consistent with passive status' ELSE 'Mixed sentiment signals - may indicate specific issues' END,
 CASE WHEN nps_category = 'detractor' AND n > 0 THEN 'Identified ' || n || ' pain points requiring attention' END,
 CASE WHEN churn_risk > 0.7 AND nps_category <> 'detractor' THEN 'High churn risk despite NPS category - prioritize retention' WHEN churn_risk < 0.3 AND nps_category = 'detractor' THEN 'Low churn risk despite detractor status - may be recoverable' END) END AS insights FROM rated""")
def e19_nps_insights(t):
    return rated(t).select("comment_id", F.array_join(nps.insights(C("nps_category"), C("sentiment"), C("n"), C("churn_risk")), "|").alias("insights"))


@query(f"SELECT comment_id, {INFER} AS inferred FROM analysis")
def e20_infer_nps(t):
    return t.analysis.select("comment_id", nps.infer(C("sentiment"), C("churn_risk")).alias("inferred"))


@query(f"SELECT comment_id, round({CONFIDENCE}, 6) AS confidence FROM analysis")
def e21_inference_confidence(t):
    return t.analysis.select("comment_id", F.round(nps.inference_confidence(C("sentiment"), C("churn_risk")), 6).alias("confidence"))


@query(f"SELECT comment_id, coalesce(CASE WHEN nps BETWEEN 0 AND 10 THEN nps END, {INFER}) AS nps, nps IS NULL AS nps_was_inferred FROM analysis")
def e22_fill_nps(t):
    return t.analysis.select("comment_id", nps.filled(C("nps"), C("sentiment"), C("churn_risk")).alias("nps"), C("nps").isNull().alias("nps_was_inferred"))


@query(f"SELECT comment_id, {RISK} AS customer_risk_level FROM rated")
def e23_customer_risk(t):
    return rated(t).select("comment_id", churn.customer_risk(C("nps_category"), C("churn_risk"), C("n")).alias("customer_risk_level"))


@query(f"SELECT comment_id, {PRIORITY} AS retention_priority FROM rated")
def e24_retention_priority(t):
    return rated(t).select("comment_id", churn.retention_priority(C("nps_category"), C("churn_risk"), C("n")).alias("retention_priority"))


@query("SELECT comment_id, CASE WHEN s >= 50 THEN 'Excellent' WHEN s >= 0 THEN 'Good' WHEN s >= -50 THEN 'Needs Improvement' ELSE 'Critical' END AS report, CASE WHEN s > 50 THEN 'Excelente' WHEN s > 0 THEN 'Bueno' ELSE 'Crítico' END AS chart FROM (SELECT comment_id, nps * 20 - 100 AS s FROM analysis WHERE nps IS NOT NULL)")
def e26_interpretation(t):
    s = C("nps") * 20 - 100
    return t.analysis.where("nps IS NOT NULL").select("comment_id", nps.interpretation(s).alias("report"), nps.chart_interpretation(s).alias("chart"))


@query(" UNION ALL ".join(f"SELECT comment_id, '{e.capitalize()}' AS emotion, {e} AS score FROM analysis" for e in K.EMOTIONS))
def b8_b9_long_emotions(t):
    return emotion.long_form(t.analysis, ["comment_id"]).select("comment_id", emotion.label(C("emotion")).alias("emotion"), "score")


# Responses

FOUND = lambda p, g: f"nullif(trim(regexp_extract(trim(content), '{p}', {g})), '')"
PAYLOAD = f"CASE WHEN regexp_matches(trim(content), '^[\\[{{]') THEN trim(content) ELSE coalesce({FOUND('(?s)```json(.*?)```', 1)}, {FOUND('(?s)```[ ]*\n(.*?)```', 1)}, {FOUND(r'(?s)\[.*\]', 0)}, {FOUND(r'(?s)\{.*\}', 0)}, trim(content)) END"
HELPERS["payloads"] = f"SELECT batch_id, expected_count, {PAYLOAD} AS payload FROM llm_raw"
REPAIRED = r"""regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload, '^[^\[{]*', ''), '[^}\]]*$', ''), ',\s*\}', '}', 'g'), ',\s*\]', ']', 'g'), '(\w+):\s*', '"\1": ', 'g'), '''', '"'), '\"', '"'), '""(\w+)""', '"\1"', 'g')"""
HELPERS["documents_of"] = f"SELECT batch_id, expected_count, CASE WHEN json_valid(payload) THEN payload WHEN json_valid({REPAIRED}) THEN {REPAIRED} END AS j FROM payloads"
HELPERS["items"] = "SELECT batch_id, pos, CASE WHEN json_type(item) = 'OBJECT' THEN item END AS item FROM (SELECT batch_id, pos, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[' || pos || ']') WHEN pos = 0 AND json_type(j) = 'OBJECT' THEN json(j) END AS item FROM documents_of, (SELECT unnest(range(3)) AS pos))"


def items(t):
    return responses.response_rows(t.llm_raw)


@query("SELECT batch_id, payload FROM payloads")
def f1_extract_json(t):
    return t.llm_raw.select("batch_id", responses.extract_json(C("content")).alias("payload"))


@query(f"SELECT batch_id, {REPAIRED} AS repaired FROM payloads")
def f2_repair_json(t):
    return t.llm_raw.select("batch_id", responses.repair_json(responses.extract_json(C("content"))).alias("repaired"))


@query("SELECT batch_id, CAST(pos AS INT) AS pos, item IS NOT NULL AS parsed, json_extract_string(item, '$.churn_risk') AS churn FROM items")
def f3_parse_batches(t):
    return items(t).select("batch_id", "pos", C("item").isNotNull().alias("parsed"), responses.part(C("item"), "$.churn_risk", "string").alias("churn"))


@query("""SELECT batch_id, CAST(pos AS INT) AS pos, greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(item, '$.churn_risk') AS DOUBLE), 0.5))) AS churn_risk,
 greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(item, '$.emotions.enojo') AS DOUBLE), 0.0))) AS enojo, greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(item, '$.emotions.alegria') AS DOUBLE), 0.0))) AS alegria,
 CASE WHEN lower(json_extract_string(item, '$.sentiment')) IN ('positive', 'negative', 'neutral') THEN lower(json_extract_string(item, '$.sentiment')) ELSE 'neutral' END AS sentiment,
 CASE WHEN batch_id % 7 = 0 AND pos = 0 THEN 'x' ELSE '' END AS points, item IS NULL AS is_fallback FROM items""")
def f4_f6_normalize_responses(t):
    return responses.normalized(items(t)).select("batch_id", "pos", "churn_risk", "enojo", "alegria", "sentiment", F.array_join("pain_points", "|").alias("points"), "is_fallback")


@query("SELECT batch_id, CAST(pos AS INT) AS pos, coalesce(json_type(json_extract(item, '$.emotions')) = 'OBJECT' AND json_type(json_extract(item, '$.pain_points')) = 'ARRAY' AND TRY_CAST(json_extract_string(item, '$.churn_risk') AS DOUBLE) IS NOT NULL AND json_extract_string(item, '$.sentiment') IS NOT NULL, false) AS valid FROM items")
def f5_valid_structure(t):
    return items(t).select("batch_id", "pos", responses.valid_structure(C("item")).alias("valid"))


@query("SELECT batch_id, round(avg(CAST(item IS NOT NULL AS INT)) * 100, 6) AS success_rate FROM items GROUP BY batch_id")
def f7_parse_rates(t):
    return rounded(responses.parse_rates(responses.normalized(items(t))))


@query("SELECT emotion, round(sum(v) / max(n), 6) AS mean FROM (SELECT 'alegria' AS emotion, CAST(json_extract_string(CASE WHEN json_valid(emotions_json) THEN emotions_json END, '$.alegria') AS DOUBLE) AS v FROM emotion_json UNION ALL SELECT 'enojo', CAST(json_extract_string(CASE WHEN json_valid(emotions_json) THEN emotions_json END, '$.enojo') AS DOUBLE) FROM emotion_json), (SELECT count(*) AS n FROM emotion_json) GROUP BY emotion")
def f8_serialized_emotions(t):
    return rounded(responses.serialized_emotion_means(t.emotion_json))


# Joins

@query("SELECT c.comment_id, lang, churn_risk FROM comments c JOIN analysis a ON c.comment_id = a.comment_id")
def g1j_join_one_to_one(t):
    return joins.join_one_to_one(t.comments, t.analysis).select("comment_id", "lang", "churn_risk")


@query("SELECT c.comment_id, coalesce(a.churn_risk, 0.0) AS churn_risk, coalesce(a.sentiment, '') AS sentiment, coalesce(a.alegria, 0.0) AS alegria FROM comments c LEFT JOIN (SELECT * FROM analysis WHERE comment_id % 2 = 0) a ON c.comment_id = a.comment_id")
def g2j_merge_results(t):
    return joins.merge_results(t.comments, t.analysis.where("churn_risk >= 0 AND comment_id % 2 = 0").drop("nps")).select("comment_id", "churn_risk", "sentiment", "alegria")


HELPERS["batches"] = "SELECT comment_id, comment, i // 3 AS batch_id, i % 3 AS pos FROM (SELECT comment_id, comment, row_number() OVER (ORDER BY comment_id) - 1 AS i FROM comments)"


@query("SELECT comment_id, b.batch_id, CAST(b.pos AS INT) AS pos, r.batch_id IS NULL AS is_fallback FROM batches b LEFT JOIN (SELECT * FROM items WHERE item IS NOT NULL) r ON b.batch_id = r.batch_id AND b.pos = r.pos")
def g3j_align_batches(t):
    batches = batching.fixed_batches(t.comments.select("comment_id"), "comment_id", 3)
    return joins.align_batches(batches, items(t).where("item IS NOT NULL").select("batch_id", "pos")).select("comment_id", "batch_id", "pos", "is_fallback")


@query(f"SELECT DISTINCT pain_point, {PAIN_CATEGORY('pain_point')} AS category FROM points")
def g4j_keyword_lookup(t):
    points = t.analysed.select(F.explode("pain_points").alias("pain_point"))
    return joins.keyword_lookup(points, joins.keyword_table(t.spark))


@query("SELECT comment_id, churn_risk FROM analysis")
def g5j_concatenate(t):
    a = t.analysis.select("comment_id", "churn_risk")
    return a.where("comment_id % 2 = 0").unionByName(a.where("comment_id % 2 = 1"))


# Batches and prompts

@query("SELECT comment_id, batch_id, CAST(pos AS INT) AS pos FROM (SELECT comment_id, i // 80 AS batch_id, i % 80 AS pos FROM (SELECT comment_id, row_number() OVER (ORDER BY comment_id) - 1 AS i FROM comments))")
def h1_fixed_batches(t):
    return batching.fixed_batches(t.comments.select("comment_id"), "comment_id", 80)


HELPERS["limits"] = "SELECT call_id, 200000 - call_id * 37 % 200001 AS rt, 450 - call_id % 451 AS rr, (call_id % 101) / 100.0 AS used, call_id % 4 AS streak FROM api_usage"


@query("""SELECT call_id, CAST(greatest(3, CASE WHEN used > 0.7 THEN floor(s * 0.6) WHEN used > 0.5 THEN floor(s * 0.75) ELSE s END) AS INT) AS size, CAST(CASE WHEN used > 0.8 THEN 50 WHEN used > 0.6 THEN 75 ELSE 100 END AS INT) AS advised FROM (
SELECT *, CASE WHEN streak >= 2 THEN greatest(5, floor(n / 4)) WHEN streak >= 1 THEN greatest(8, floor(n / 2)) ELSE n END AS s FROM (
SELECT *, greatest(1, least(CASE WHEN rr < 5 THEN least(m, 10) ELSE m END, 100)) AS n FROM (
SELECT *, CASE WHEN rt < 40000 THEN least(74, floor(rt / 300)) ELSE 74 END AS m FROM limits)))""")
def h2_batch_size(t):
    u = t.api_usage
    state = F.struct((200000 - C("call_id") * 37 % 200001).alias("remaining_tokens"), F.lit(200000).alias("tokens_per_minute"), (450 - C("call_id") % 451).alias("remaining_requests"), (C("call_id") % 101 / 100.0).alias("used_share"), (C("call_id") % 4).alias("rate_limit_streak"))
    return u.select("call_id", batching.batch_size(state).alias("size"), batching.advised_batch_size(C("call_id") % 101 / 100.0).alias("advised"))


@query("SELECT comment_id, source, tokens, CAST(floor((sum(tokens) OVER (PARTITION BY source ORDER BY comment_id) - tokens) / 6480) AS BIGINT) AS batch_no FROM (SELECT comment_id, source, greatest(1, CAST(floor(length(coalesce(comment, '')) / 4.0) AS BIGINT)) AS tokens FROM comments)")
def h3_token_batches(t):
    return batching.token_batches(t.comments.select("comment_id", "source", "comment"), "comment_id", "comment", "source").drop("comment")


@query("SELECT batch_id, count(*) AS comments, CAST(800 + sum(greatest(1, length(coalesce(comment, '')) // 4)) + floor((800 + sum(greatest(1, length(coalesce(comment, '')) // 4))) * 0.5) AS BIGINT) AS request_tokens, CAST(floor(sum(length(coalesce(comment, ''))) / 4.0) + 50 * count(*) AS BIGINT) AS simple_tokens FROM batches GROUP BY batch_id")
def d12_batch_tokens(t):
    return batching.batch_token_totals(batching.fixed_batches(t.comments.select("comment_id", "comment"), "comment_id", 3), "comment")


@query("SELECT batch_id, CAST(count(*) AS INT) AS n_comments, string_agg('COMENTARIO_' || (pos + 1) || ': ' || coalesce(comment, '') || chr(10), '---' || chr(10) ORDER BY pos) AS prompt FROM batches GROUP BY batch_id")
def d16_batch_prompts(t):
    return batching.prompts(batching.fixed_batches(t.comments.select("comment_id", "comment"), "comment_id", 3), "comment")


# Scorers and analyzers

HELPERS["scored"] = "SELECT comment_id, comment, nps, nota, lang, source, " + f"CASE WHEN {GOOD} AND NOT {BAD} THEN 'positive' WHEN {BAD} AND NOT {GOOD} THEN 'negative' ELSE 'neutral' END AS sentiment, coalesce({BAD}, false) AS bad FROM cleaned"
LEX = {e: next((k for k, v in K.LEXICON_EMOTIONS.items() if e in v), "") for e in K.EMOTIONS}
HELPERS["lexicon"] = "SELECT *, " + ", ".join(f"CAST(CASE WHEN sentiment = '{k}' THEN 0.8 ELSE 0.15 END AS DOUBLE) AS {e}" for e, k in LEX.items()) + ", CAST(CASE WHEN bad THEN 0.85 ELSE 0.2 END AS DOUBLE) AS churn_risk, CASE WHEN bad THEN 1 ELSE 0 END AS n FROM scored"
HELPERS["enriched"] = f"SELECT *, {CATEGORY('nps')} AS nps_category FROM (SELECT * REPLACE (coalesce(CASE WHEN nps BETWEEN 0 AND 10 THEN nps END, {INFER}) AS nps), nps IS NULL AS nps_was_inferred FROM lexicon)"


@query("SELECT comment_id, sentiment, churn_risk, alegria, enojo, sorpresa, n AS points FROM lexicon")
def d17_lexicon_scores(t):
    s = scoring.lexicon_scores(pipeline.clean(t.comments))
    return s.select("comment_id", "sentiment", "churn_risk", "alegria", "enojo", "sorpresa", F.size("pain_points").alias("points"))


@query("SELECT comment_id, sentiment, churn_risk, false AS is_fallback FROM lexicon")
def k1_score_comments(t):
    got = scoring.score_comments(pipeline.clean(t.comments), scoring.lexicon_scorer)
    j = F.get_json_object
    return got.select("comment_id", j("content", "$.sentiment").alias("sentiment"), j("content", "$.churn_risk").try_cast("double").alias("churn_risk"), "is_fallback")


@query(f"SELECT comment_id, nps_category, {RISK_CATEGORY('churn_risk')} AS churn_category, {DOMINANT} AS dominant_emotion, CAST(n AS INT) AS pain_point_count FROM rated")
def k2_analyzers(t):
    return scoring.analyze(t.analysed).select("comment_id", *scoring.ANALYZERS)


@query(f"SELECT comment_id, sentiment, churn_risk, {CATEGORY('nps')} AS nps_category FROM lexicon")
def p4_analyze(t):
    return pipeline.analyze(pipeline.clean(t.comments)).select("comment_id", "sentiment", "churn_risk", "nps_category")


@query(f"SELECT comment_id, nps, nps_was_inferred, nps_category, {MEAN(K.CATEGORIES['positivas'])} AS emo_category_positivas, {DOMINANT} AS dominant_emotion, round({SPREAD}, 6) AS emotion_intensity, round({SENTIMENT_CONFIDENCE}, 6) AS sentiment_confidence, {RISK} AS customer_risk_level, {PRIORITY} AS retention_priority FROM enriched")
def p5_enrich(t):
    e = pipeline.enrich(pipeline.analyze(pipeline.clean(t.comments)))
    return rounded(e.select("comment_id", "nps", "nps_was_inferred", "nps_category", "emo_category_positivas", "dominant_emotion", "emotion_intensity", "sentiment_confidence", "customer_risk_level", "retention_priority"), 6, "emotion_intensity", "sentiment_confidence")
