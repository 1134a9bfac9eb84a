"""Sources, schema operators, filters, and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter import constants as K
from voxmeter.functions import text
from voxmeter.operators import quality
from voxmeter.plans import pipeline
from voxmeter.queries.registry import HELPERS, query
from voxmeter.sources import io
from voxmeter.sources.scratch import scratch_path

L = "[" + text.LETTERS + "]"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def n_of(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words) + ")"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def nested(c: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        c = "replace({}, '{}', '{}')".format(c, a.replace("'", "''"), b.replace("'", "''"))
    return c


def clean_sql(c: str) -> str:
    t = sub(sub(sub(c, r"^\s+|\s+$", ""), r"\s+", " "), r"[^\p{L}\p{N}_\s.,!?¿¡()-]", "")
    head = f"substr({t}, 1, 2000)"
    return f"coalesce(CASE WHEN length({t}) > 2000 THEN CASE WHEN contains({head}, ' ') THEN regexp_extract({head}, '(?s)^(.*) [^ ]*$', 1) ELSE {head} END || '...' ELSE {t} END, '')"


def nps_sql(c: str) -> str:
    v = f"lower({sub(c, r'^\s+|\s+$', '')})"
    n = lambda p: f"TRY_CAST(nullif(regexp_extract({v}, '{p}', 1), '') AS DOUBLE)"
    ten = n(r"(\d+)/10")
    return f"coalesce({n(r'\b([0-9]|10)\b')}, {n(r'nps[:\s]*([0-9]|10)')}, {n(r'score[:\s]*([0-9]|10)')}, {n(r'rating[:\s]*([0-9]|10)')}, CASE WHEN {ten} BETWEEN 0 AND 10 THEN {ten} END, CASE WHEN regexp_matches({v}, '\\d+%') THEN least(10.0, {n(r'(\d+)%')} / 10) END, CASE WHEN regexp_matches({v}, '\\d+/5') THEN least(10.0, {n(r'(\d+)/5')} * 2) END, CASE WHEN regexp_matches({v}, '\\d+/100') THEN least(10.0, {n(r'(\d+)/100')} / 10) END, CASE WHEN {any_of(v, K.NPS_POSITIVE)} THEN 9.0 WHEN {any_of(v, K.NPS_NEGATIVE)} THEN 3.0 END)"


def valid_sql(c: str) -> str:
    return f"(length({c}) >= 5 AND regexp_replace({c}, '^\\s+|\\s+$', '', 'g') <> '' AND regexp_matches({c}, '{L}'))"


def light_sql(c: str) -> str:
    return sub(nested(sub(c, r"\s+", " "), K.MOJIBAKE), r"^\s+|\s+$", "")


def fix_sql(c: str) -> str:
    return sub(sub(sub(c, r"([.!?]){2,}", r"\1"), r"\s+([.!?,:;])", r"\1"), rf"([.!?])\s*({L})", r"\1 \2")


def chat_sql(c: str) -> str:
    """Words of one letter spelled out; twice, as a match takes the sign after it along."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    for short, word in (("q", "que"), ("x", "por"), ("k", "que")):
        for _ in range(2):
            c = sub(c, rf"(^|{edge})[{short}{short.upper()}]($|{edge})", rf"\1{word}\2")
    return c


#: The characters of list l without the third and later ones of a run, other than of l and r: RE2 has no back-references.
SHORT_RUNS = "array_to_string(list_filter(l, lambda x, i: i < 3 OR x IN ('l', 'r') OR x <> l[i - 1] OR x <> l[i - 2]), '')"


def marks_sql(c: str) -> str:
    return sub(f"translate({c}, '„‚—–', '\"''--')", r"\.{3,}", "...")


def full_sql(table: str, others: str) -> str:
    """The table's comments fully normalised."""
    before = nested(sub(nested("comment", K.MOJIBAKE), "<[^>]+>", ""), K.ENTITIES)
    before = chat_sql(fix_sql(sub(f"nfc_normalize({before})", r"\s+", " ")))
    return f"SELECT {others}, {sub(marks_sql(SHORT_RUNS), r'^\s+|\s+$', '')} AS comment FROM (SELECT *, string_split({before}, '') AS l FROM {table})"


HELPERS["cleaned"] = f"SELECT * FROM (SELECT comment_id, lang, source, nps_raw, CASE WHEN nota >= 0 THEN nota END AS nota, {clean_sql('comment')} AS comment, {nps_sql('nps_raw')} AS nps FROM comments WHERE comment IS NOT NULL) WHERE {valid_sql('comment')}"


def comment_file(t, rows=None) -> str:
    """The comments as a CSV file with other column names."""
    path = scratch_path(t.spark, "comments") + ".csv"
    rows = t.comments if rows is None else rows
    named = rows.select(F.col("nps_raw").alias(" Puntaje NPS "), F.col("nota").alias("Valoración"), F.col("comment").alias("Comentario Final Limpio"), "comment_id", "lang", "source")
    io.write_csv({"Comentarios": named}, path)
    return path


@query("SELECT comment_id, nps_raw, nota, comment FROM comments")
def a1_read_comments(t):
    read = io.rename_columns(io.read_comments(t.spark, comment_file(t)))
    return read.select(F.col("comment_id").cast("long"), F.col("NPS").alias("nps_raw"), text.to_number(F.col("Nota")).alias("nota"), F.col("Comentario Final").alias("comment"))


@query("SELECT 'whole' AS file, count(*) AS n_rows, true AS has_required, '' AS missing FROM comments UNION ALL SELECT 'part', count(*), false, 'Nota,Comentario Final' FROM comments")
def a2_required_columns(t):
    read = io.rename_columns(io.read_comments(t.spark, comment_file(t)))
    one = lambda name, df: io.table_info(df).select(F.lit(name).alias("file"), "n_rows", "has_required", F.array_join("missing", ",").alias("missing"))
    return one("whole", read).unionByName(one("part", read.drop("Nota", "Comentario Final")))


@query("SELECT comment_id, nps, churn_risk, sentiment, replace(pain_points_csv, '|', ', ') AS pain_points FROM analysis")
def a5_write_csv(t):
    path = scratch_path(t.spark, "report") + ".csv"
    io.write_csv({"Resumen": t.analysed.limit(1), "Analisis_Completo": t.analysed.select("comment_id", "nps", "churn_risk", "sentiment", "pain_points")}, path)
    return io.read_comments(t.spark, path).select(F.col("comment_id").cast("long"), F.col("nps").cast("double"), F.col("churn_risk").cast("double"), "sentiment", F.coalesce("pain_points", F.lit("")).alias("pain_points"))


@query("SELECT 'Analisis_Completo' AS dataset, comment_id, churn_risk, pain_points_csv AS pain_points FROM analysis UNION ALL SELECT 'Altos', comment_id, churn_risk, NULL FROM analysis WHERE churn_risk > 0.7")
def a6_write_json(t):
    path, a = scratch_path(t.spark, "report"), t.analysed.select("comment_id", "churn_risk", "pain_points")
    io.write_json({"Analisis_Completo": a, "Altos": a.where("churn_risk > 0.7").drop("pain_points")}, path)
    read = lambda name: t.spark.read.json(f"{path}/{name}").withColumn("dataset", F.lit(name))
    return read("Analisis_Completo").withColumn("pain_points", F.array_join("pain_points", "|")).unionByName(read("Altos"), allowMissingColumns=True)


@query("SELECT count(*) AS n_rows, 6 AS n_columns, 'comment_id,lang,source,nps_raw,nota,comment' AS column_names, true AS has_required, '' AS missing FROM comments")
def a3_table_info(t):
    info = io.table_info(t.comments, ["nota", "comment"])
    return info.withColumns({c: F.array_join(c, ",") for c in ("column_names", "missing")})


@query("SELECT comment_id, nota, comment FROM comments ORDER BY comment_id LIMIT 5")
def a4_preview(t):
    return io.preview(t.comments, "comment_id", 5, io.EXPORT_PREVIEW)


@query("SELECT * FROM analysis ORDER BY comment_id LIMIT 100 OFFSET 100")
def a8_result_page(t):
    return io.page(t.analysis, "comment_id", 1)


@query("SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages FROM analysis")
def a8_page_count(t):
    return io.page_count(t.analysis)


@query('SELECT comment_id, nps_raw AS "NPS", nota AS "Nota", comment AS "Comentario Final" FROM comments')
def b1_b2_rename_columns(t):
    return io.rename_columns(t.comments.select("comment_id", F.col("nps_raw").alias(" Puntaje NPS "), F.col("nota").alias("Valoración"), F.col("comment").alias("Comentario Final Limpio")))


@query("SELECT comment_id, churn_risk FROM analysis")
def b3_drop_internal(t):
    a = t.analysis.select("comment_id", "churn_risk")
    return io.drop_internal(a.withColumns({"_raw": F.lit(1), "index": F.lit(2), "temp_path": F.lit("x")}))


@query("SELECT comment_id, nps, churn_risk, sentiment, pain_points_csv FROM analysis")
def b4_drop_emotions(t):
    return io.drop_emotions(t.analysis)


@query("SELECT comment_id, TRY_CAST(trim(nps_raw) AS DOUBLE) AS nps, nota FROM comments")
def b6_to_number(t):
    return t.comments.select("comment_id", text.to_number(F.trim("nps_raw")).alias("nps"), text.to_number(F.col("nota")).alias("nota"))


@query(f"SELECT comment_id, {sub(nested(sub('source', r'\s+', ' '), K.MOJIBAKE), r'^\s+|\s+$', '')} AS source FROM comments")
def b7_normalize_other_columns(t):
    return pipeline.normalize(t.comments.select("comment_id", "source", F.lit("x").alias("comment"))).select("comment_id", "source")


@query(f"SELECT comment_id, comment FROM comments WHERE comment IS NOT NULL")
def c1_drop_null_comments(t):
    return t.comments.select("comment_id", "comment").na.drop(subset=["comment"])


@query("SELECT comment_id, CASE WHEN nota >= 0 THEN nota END AS nota FROM comments")
def c2_clean_ratings(t):
    return t.comments.select("comment_id", F.when(F.col("nota") >= 0, F.col("nota")).alias("nota"))


@query(f"SELECT comment_id, comment FROM comments WHERE {valid_sql('comment')}")
def c3_valid_comments(t):
    return t.comments.where(text.valid_comment(F.col("comment"))).select("comment_id", "comment")


@query("SELECT comment_id FROM comments")
def c4_require_size(t):
    return quality.require_size(t.comments, most=None).select("comment_id")


@query("SELECT comment_id, churn_risk FROM analysis WHERE churn_risk > 0.7")
def c5_high_risk(t):
    return t.analysis.where("churn_risk > 0.7").select("comment_id", "churn_risk")


@query("SELECT comment_id, enojo FROM analysis WHERE enojo > 0.5")
def c6_emotion_over(t):
    return t.analysis.where(F.col("enojo") > 0.5).select("comment_id", "enojo")


@query("SELECT comment_id, CASE WHEN sentiment IN ('positive', 'negative') THEN sentiment ELSE 'neutral' END AS sentiment FROM analysis")
def c7_known_sentiment(t):
    s = F.col("sentiment")
    return t.analysis.select("comment_id", F.when(s.isin("positive", "negative"), s).otherwise("neutral").alias("sentiment"))


@query("SELECT call_id, processing_time FROM api_usage WHERE sla_category = 'llm_batch' AND error_count = 0")
def c8_filter_calls(t):
    return t.api_usage.where((F.col("sla_category") == "llm_batch") & (F.col("error_count") == 0)).select("call_id", "processing_time")


@query(f"SELECT comment_id, {clean_sql('comment')} AS comment FROM comments")
def d1_clean_comment(t):
    return t.comments.select("comment_id", text.clean_comment(F.col("comment")).alias("comment"))


@query(f"SELECT comment_id, {nps_sql('nps_raw')} AS nps FROM comments")
def d2_nps_parse(t):
    return t.comments.select("comment_id", text.nps_parse(F.col("nps_raw")).alias("nps"))


@query(f"SELECT comment_id, {nested('comment', K.MOJIBAKE)} AS comment FROM comments")
def d3_fix_encoding(t):
    return t.comments.select("comment_id", text.fix_encoding(F.col("comment")).alias("comment"))


@query(f"SELECT page_id, {nested(sub('html', '<[^>]+>', ''), K.ENTITIES)} AS text FROM pages")
def d4_strip_html(t):
    return t.raw("pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("SELECT comment_id, nfc_normalize(comment) AS nfc, strip_accents(comment) AS plain FROM comments")
def d5_unicode_form(t):
    return t.comments.select("comment_id", text.nfc(F.col("comment")).alias("nfc"), text.without_accents(F.col("comment")).alias("plain"))


@query(f"SELECT comment_id, {sub('comment', r'\s+', ' ')} AS comment FROM comments")
def d6_normalize_space(t):
    return t.comments.select("comment_id", text.normalize_space(F.col("comment")).alias("comment"))


@query(f"SELECT comment_id, {fix_sql('comment')} AS comment FROM comments")
def d7_fix_punctuation(t):
    return t.comments.select("comment_id", text.fix_punctuation(F.col("comment")).alias("comment"))


@query(f"SELECT comment_id, {SHORT_RUNS} AS comment FROM (SELECT comment_id, string_split({chat_sql(fix_sql('comment'))}, '') AS l FROM comments)")
def d7_fix_common(t):
    return t.comments.select("comment_id", text.fix_common(F.col("comment")).alias("comment"))


@query("SELECT comment_id, " + sub("translate(comment, '„‚—–', '\"''--')", r"\.{3,}", "...") + " AS comment FROM comments")
def d8_standard_marks(t):
    return t.comments.select("comment_id", text.standard_marks(F.col("comment")).alias("comment"))


@query(full_sql("comments", "comment_id"))
def d9_normalize_text(t):
    return text.normalize_column(t.comments.select("comment_id", "comment"), "comment")


@query(f"SELECT conv_id, turn, {sub(nested(sub('text', r'\s+', ' '), K.MOJIBAKE), r'^\s+|\s+$', '')} AS text FROM conversations WHERE role = 'user'")
def d10_normalize_light(t):
    return t.raw("conversations").where("role = 'user'").select("conv_id", "turn", text.normalize_light(F.col("text")).alias("text"))


@query(f"""SELECT comment_id, length(comment) AS original_length, length(cleaned) AS normalized_length, length(cleaned) - length(comment) AS length_change,
 len(regexp_extract_all(comment, '<[^>]+>')) AS html_tags_removed, regexp_matches(comment, '\\s{{2,}}') AS whitespace_normalized,
 len(list_filter(list_zip(string_split(comment, ''), string_split(cleaned, ''), true), lambda p: p[1] <> p[2])) AS character_changes
FROM (SELECT comment_id, comment, {sub('comment', '<[^>]+>', '')} AS cleaned FROM comments WHERE comment IS NOT NULL)""")
def d11_normalization_stats(t):
    c = F.col("comment")
    return t.comments.where(c.isNotNull()).select("comment_id", text.normalization_stats(c, F.regexp_replace(c, "<[^>]+>", "")).alias("s")).select("comment_id", "s.*")


@query("SELECT comment_id, greatest(1, CAST(floor(length(comment) / 4.0) AS BIGINT)) AS tokens FROM comments WHERE comment IS NOT NULL")
def d12_estimate_tokens(t):
    return t.comments.where("comment IS NOT NULL").select("comment_id", text.estimate_tokens(F.col("comment")).alias("tokens"))


CHURN = f"least(1.0, {n_of("lower(coalesce(comment, ''))", K.CHURN_HIGH)} * 0.3 + {n_of("lower(coalesce(comment, ''))", K.CHURN_MEDIUM)} * 0.1)"


@query(f"SELECT comment_id, round(CAST({CHURN} AS DOUBLE), 6) AS score FROM comments")
def d13_churn_keywords(t):
    return t.comments.select("comment_id", F.round(text.churn_keywords(F.col("comment")), 6).alias("score"))


@query(f"SELECT comment_id, {n_of('lower(comment)', K.SPANISH_INDICATORS)} >= 2 AS spanish FROM comments WHERE comment IS NOT NULL")
def d14_is_spanish(t):
    return t.comments.where("comment IS NOT NULL").select("comment_id", text.is_spanish(F.col("comment")).alias("spanish"))


@query("SELECT comment_id, array_to_string(CASE WHEN pain_points_csv = '' THEN [] ELSE string_split(pain_points_csv, '|') END, ', ') AS pain_points_text, CAST(CASE WHEN pain_points_csv = '' THEN 0 ELSE len(string_split(pain_points_csv, '|')) END AS INT) AS pain_point_count FROM analysis")
def d15_e25_pain_point_text(t):
    return t.analysed.select("comment_id", F.array_join("pain_points", ", ").alias("pain_points_text"), F.size("pain_points").alias("pain_point_count"))


GOOD, BAD = any_of("lower(comment)", K.LEXICON_POSITIVE), any_of("lower(comment)", K.LEXICON_NEGATIVE)


@query(f"SELECT comment_id, CASE WHEN {GOOD} AND NOT {BAD} THEN 'positive' WHEN {BAD} AND NOT {GOOD} THEN 'negative' ELSE 'neutral' END AS sentiment FROM comments")
def d17_lexicon_sentiment(t):
    return t.comments.select("comment_id", text.lexicon_sentiment(F.col("comment")).alias("sentiment"))


@query("SELECT comment_id, lang, source, nps_raw, nota, comment, nps FROM cleaned")
def p1_clean(t):
    return pipeline.clean(t.comments)


HELPERS["normal"] = full_sql("cleaned", f"comment_id, nota, nps, {', '.join(f'{light_sql(c)} AS {c}' for c in ('lang', 'source', 'nps_raw'))}")


@query("SELECT comment_id, lang, source, nps_raw, nota, comment, nps FROM normal")
def p3_normalize(t):
    return pipeline.normalize(pipeline.clean(t.comments))
