"""The registered queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.llm import decontam, embeddings, htmltext, langid, lines, packing, periodic, quality, sharding, simhash, spelling, surrogates, urls
from voxmeter.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


ORACLES["op3_url_filters"] = f"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, s, v) AS (VALUES {", ".join(map(str, urls.RULES))})
SELECT page_id, host, path,
  (SELECT max_by(h || s, length(h || s)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS rule,
  coalesce((SELECT max_by(v, length(h || s)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)), 'allow') AS verdict
FROM p
"""


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The given tables are no secret; a session with its own data sets a key of its own.
    key = spark.conf.get("spark.voxmeter.surrogates.key", "a key for the given tables")
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), key.encode())


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # Quotients of numbers of words are told apart, and equal ones are equal, as long as length * period is below 2**52.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.withColumn("exponent_milli", F.expr("(1000 * length) div period"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repetitions that the contract plants in every tenth document: its words from place a on are the first p of them again and again."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("(h div 10) % n").cast("int"))).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)").cast("int"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelling.word_rows(table(spark, sf_dir, "documents")).where(F.length("word") >= spelling.MIN_LENGTH)
    # The contract's misspellings: an occurrence in 31 loses a letter.
    h = F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.col("word")).cast("binary"))
    gone = (F.col("h") % F.length("word")).cast("int")
    without = F.concat(F.substring("word", F.lit(1), gone), F.substring("word", gone + 2, F.length("word")))
    rows = rows.withColumn("h", h).select("id", F.when(F.col("h") % 31 == 0, without).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(spelling.count_words(rows))


#: Unsigned CRC-32 in SQL: the table by its rule, and a text's bytes folded over it.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS tab"


def crc32_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda x, y: xor(x // 256, tab[xor(x, y) % 256 + 1])))"


ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE t AS MATERIALIZED ({CRC_TABLE}),
o AS (SELECT doc_id || ':' AS d, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
h AS MATERIALIZED (SELECT w, {crc32_sql("d || w")} AS h FROM o, t WHERE length(w) >= 7),
v AS MATERIALIZED (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, count(*) AS n
  FROM h GROUP BY 1 HAVING count(*) >= 2 AND length(word) >= 7),
g AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, g.n, v.word, v.n FROM g JOIN v ON g.rest = v.word
  UNION SELECT v.word, v.n, g.word, g.n FROM g JOIN v ON g.rest = v.word),
f AS MATERIALIZED (
  SELECT v.word, v.n, count(near.other) AS n_near, first(near.other ORDER BY near.m DESC, near.other) AS best, max(near.m) AS best_n
  FROM v LEFT JOIN near ON v.word = near.word GROUP BY ALL),
s AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM f),
r AS (SELECT word, word AS root, 0 AS k FROM s UNION ALL SELECT r.word, s.form, k + 1 FROM r JOIN s ON r.root = s.word WHERE s.form IS NOT NULL)
SELECT word, form, (SELECT max_by(r.root, r.k) FROM r WHERE r.word = s.word) AS root, n, n_near, form_n FROM s
"""


@query
def op13_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).drop("copy")


ORACLES["op13_stratified_shards"] = f"""
WITH t AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, t),
h AS (SELECT *, ('0x' || substr(md5('shuffle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32), 1, 8))::BIGINT / 4294967296::DOUBLE AS h,
  ('0x' || substr(md5('shuffle:source:' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM d),
p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 + u) / count(*) OVER (PARTITION BY source) AS place FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY place, h, doc_id NULLS FIRST, size, text_crc32, source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM p)
SELECT doc_id, source, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * {sharding.SHARDS} // total)::INT AS shard,
  (pos - (pos * {sharding.SHARDS} // total * total + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM o
"""


ORACLES["op11_periodic_runs"] = rf"""
WITH t AS MATERIALIZED ({CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents, t),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
p AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM e),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM p),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word WHERE b.i > a.i AND b.i - a.i <= a.n // 4),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
report AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_words FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_words, '')) AS collapsed_sha256
FROM documents LEFT JOIN report USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op7_embedding_dedup"] = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0)) THEN embedding::DOUBLE[] END AS x FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, (SELECT min(b) FROM reached WHERE reached.a = v.vec_id) AS component_id,
  (SELECT min(b) FROM reached WHERE reached.a = v.vec_id) = vec_id AS kept FROM v
"""
