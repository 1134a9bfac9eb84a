"""Survey, analysis, usage-log and raw-response views over the given tables, in SQL that Spark and DuckDB share.

All rows and whole texts of ``documents`` and ``events`` are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxmeter.constants import EMOTIONS

_EMOTION_COLUMNS = ",\n ".join(f"CAST((doc_id * {2 * i + 3} + {7 * i}) % 101 AS DOUBLE) / 100 AS {e}" for i, e in enumerate(EMOTIONS))

VIEWS = {
    "comments": """SELECT doc_id AS comment_id, lang, source,
 CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '8/10' WHEN 2 THEN '80%' WHEN 3 THEN '4/5' WHEN 4 THEN 'NPS: 10'
  WHEN 5 THEN 'nps10' WHEN 6 THEN 'Excelente' WHEN 7 THEN 'muy malo' WHEN 8 THEN '80/100' WHEN 9 THEN 'n/a'
  WHEN 10 THEN '11' WHEN 11 THEN ' 9 ' ELSE CAST(doc_id % 11 AS STRING) END AS nps_raw,
 CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 7 - 1 AS DOUBLE) END AS nota,
 CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '12 34' WHEN doc_id % 37 = 0 THEN 'ok'
  ELSE text || CASE doc_id % 8
   WHEN 0 THEN ' quiero cancelar, es horrible' WHEN 1 THEN ' estoy decepcionado y molesto' WHEN 2 THEN ' excelente y genial'
   WHEN 3 THEN ' <b>q tal</b> x favor &amp; k mas???' WHEN 4 THEN ' muuuuy  bueno !' WHEN 5 THEN ' problema con la entrega, queja'
   WHEN 6 THEN ' no recomiendo, busco competencia' ELSE ' gracias' END END AS comment
FROM {documents}""",
    "analysis": f"""SELECT doc_id AS comment_id,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) END AS nps,
 {_EMOTION_COLUMNS},
 CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS churn_risk,
 CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
 CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'mala calidad' WHEN 2 THEN 'demora en entrega|precio alto'
  WHEN 3 THEN 'atencion lenta|interfaz confusa|sin aviso' WHEN 4 THEN 'otro tema' ELSE 'precio alto|mala calidad|demora en entrega|otro tema' END AS pain_points_csv
FROM {{documents}}""",
    "api_usage": """SELECT event_id AS call_id, ts, user_id AS api_key_id,
 CASE event_type WHEN 'view' THEN 'llm_batch' WHEN 'click' THEN 'file_processing' WHEN 'purchase' THEN 'data_export' ELSE 'pipeline_execution' END AS sla_category,
 CAST(10 + event_id % 71 AS INT) AS batch_size, CAST(800 + 150 * (10 + event_id % 71) AS BIGINT) AS tokens_used,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS requests_made, value / 10 AS processing_time,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count, event_type = 'error' AND event_id % 2 = 0 AS rate_limited
FROM {events}""",
    "llm_raw": """SELECT doc_id AS batch_id, 3 AS expected_count,
 CASE doc_id % 7
  WHEN 0 THEN '[{{"emotions":{{"alegria":0.8}},"pain_points":["x"],"churn_risk":0.2,"sentiment":"positive"}},{{"emotions":{{}},"pain_points":[],"churn_risk":1.7,"sentiment":"NEGATIVE"}},{{"emotions":{{"enojo":"0.9"}},"pain_points":null,"churn_risk":"bad","sentiment":"meh"}}]'
  WHEN 1 THEN 'Claro: ```json' || chr(10) || '[{{"churn_risk":0.4}},{{"churn_risk":0.6}}]' || chr(10) || '``` listo'
  WHEN 2 THEN '[{{"churn_risk":0.4,}},{{"churn_risk":0.6}},]'
  WHEN 3 THEN '{{"churn_risk":0.9,"sentiment":"negative"}}'
  WHEN 4 THEN '[{{"churn_risk":0.1}},5,{{"churn_risk":0.3}},{{"churn_risk":0.5}}]'
  WHEN 5 THEN 'no hay respuesta' ELSE NULL END AS content
FROM {documents}""",
    "emotion_json": """SELECT doc_id AS comment_id, CASE doc_id % 4 WHEN 0 THEN '{{"alegria":0.5,"enojo":0.25}}' WHEN 1 THEN '{{"alegria":1.0}}' WHEN 2 THEN 'bad' ELSE NULL END AS emotions_json FROM {documents}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "events") if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **tables)


def oracle(sql: str, extra: dict[str, str]) -> str:
    """The SQL with the views and helper queries it uses, directly or not, as common table expressions."""
    known = {n: q.format(documents="documents", events="events") for n, q in VIEWS.items()} | extra
    used: list[str] = []

    def visit(text: str) -> None:
        for n, q in known.items():
            if n not in used and _mentions(text, n):
                visit(q)
                if n not in used:
                    used.append(n)

    visit(sql)
    return as_bigint(("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in used) + "\n" if used else "") + sql)


def as_bigint(sql: str) -> str:
    """count_if(..) as BIGINT; DuckDB's own type for it has 128 bits."""
    out, at = [], 0
    for m in re.finditer(r"count_if\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at : m.start()], f"CAST({sql[m.start() : end]} AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I) is not None
