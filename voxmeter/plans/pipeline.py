"""Composed operators: clean, validate, normalise, analyse, enrich, and the whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.constants import EMOTIONS, MAX_BATCH, MAX_ROWS
from voxmeter.functions import churn, nps, pain, responses, text
from voxmeter.functions.emotion import clamp, dominant, sentiment_confidence, spread, with_categories
from voxmeter.operators import batching, quality, reports, scoring
from voxmeter.sources import io
from voxmeter.sources.scratch import scratch_path, written


def clean(df: DataFrame) -> DataFrame:
    """Comments, ratings and NPS cleaned; rows without a usable comment go. Columns comment, nps_raw and nota."""
    # An array of the cleaned comment, or of nothing: it is made once, for the value and for the filter.
    usable = F.filter(F.array(text.clean_comment(F.col("comment"))), lambda c: text.valid_comment(c))
    out = df.where(F.col("comment").isNotNull()).withColumn("comment", F.explode(usable))
    out = out.withColumns({"nps": text.nps_parse(F.col("nps_raw")), "nota": text.to_number(F.col("nota"))})
    return out.withColumn("nota", F.when(F.col("nota") >= 0, F.col("nota")))


def validate(df: DataFrame, max_rows: int | None = MAX_ROWS) -> dict[str, DataFrame]:
    """Raises on missing columns or a bad size; the reports of the columns."""
    io.require_columns(df, ["nps", "nota", "comment"])
    quality.require_size(df, most=max_rows)
    return {"nps": quality.validate_nps(df), "rating": quality.validate_rating(df), "comment": quality.validate_comments(df)}


def light_columns(df: DataFrame, comment: str) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string" and c != comment and not c.startswith("__")]


def has_letters(c: str) -> Column:
    return F.coalesce(F.max(F.regexp_like(c, F.lit(r"\p{L}"))), F.lit(False))


def normalize(df: DataFrame, comment: str = "comment", lettered: list[str] | None = None) -> DataFrame:
    """The comment fully, and every other text column that has a letter somewhere lightly. ``lettered`` names those if they are known."""
    out, others = text.normalize_column(df, comment), light_columns(df, comment)
    if lettered is not None:
        return out.withColumns({c: text.normalize_light(F.col(c)) for c in lettered})
    if not others:
        return out
    # One row that says for each column whether it has a letter.
    known = df.agg(*[has_letters(c).alias(f"__{c}") for c in others])
    light = {c: F.when(F.col(f"__{c}"), text.normalize_light(F.col(c))).otherwise(F.col(c)) for c in others}
    return out.crossJoin(F.broadcast(known)).withColumns(light).drop(*known.columns)


def scored_by(df: DataFrame, scorer: scoring.Scorer, answers: str | None = None) -> DataFrame:
    """``df``, which has batch_id and pos, with what the scorer says of each comment, in the form of the lexicon's scores. Answers are kept under ``answers`` and asked for once."""
    batches = written(scoring.gathered(df), "batches")
    path = answers or scratch_path(df.sparkSession, "answers")
    said = scoring.answered(batches, scoring.ask(batches, scorer, path))
    kept = [c for c in df.columns if c not in (*EMOTIONS, "pain_points", "churn_risk", "sentiment", "is_fallback", "item")]
    return responses.normalized(said.select(*kept, responses.first_item(F.col("content")).alias("item"))).drop("is_fallback")


def analyze(df: DataFrame, scorer: scoring.Scorer | None = None, answers: str | None = None) -> DataFrame:
    """Scores, by the lexicon if no scorer is given, with their values in range, and the NPS category. A scorer's rows have batch_id and pos."""
    out = scoring.lexicon_scores(df) if scorer is None else scored_by(df, scorer, answers)
    out = out.withColumns({e: clamp(F.col(e)) for e in EMOTIONS} | {"churn_risk": churn.base(F.col("churn_risk")), "pain_points": pain.clean(F.col("pain_points"))})
    return out.withColumn("nps_category", nps.category(F.col("nps")))


def enrich(df: DataFrame) -> DataFrame:
    """Analysed rows with the inferred NPS and all derived columns."""
    out = df.withColumn("nps_was_inferred", F.col("nps").isNull()).withColumn("nps", nps.filled(F.col("nps"), F.col("sentiment"), F.col("churn_risk")))
    out = with_categories(out).withColumns({"nps_category": nps.category(F.col("nps")), "pain_point_count": F.size("pain_points"), "pain_points_text": F.array_join("pain_points", ", "), "dominant_emotion": dominant(), "emotion_intensity": spread(), "sentiment_confidence": sentiment_confidence(F.col("sentiment"))})
    derived = [F.col("nps_category"), F.col("churn_risk"), F.col("pain_point_count")]
    return out.withColumns({"customer_risk_level": churn.customer_risk(*derived), "retention_priority": churn.retention_priority(*derived)})


def run_pipeline(spark: SparkSession, path: str, comment_id: str | None = None, scorer: scoring.Scorer | None = None, batch_size: int = MAX_BATCH, max_rows: int | None = None, usage: dict[str, float] | None = None, answers: str | None = None) -> dict[str, DataFrame]:
    """A comment file to its enriched rows, the reports of its columns, summary and metrics.

    The file is read and cleaned in one pass, which also counts for the reports and is
    written to the shared folder; an error if a column is missing, no row is left, or more
    than ``max_rows`` are. Rows keep the file's order (files by name) and are cut into
    batches of ``batch_size``, or of the size that the state of the limits ``usage`` allows.
    ``comment_id`` names a column of unique ids; without it ids are the rows' places. A scorer
    is asked once for each batch, and its answers are kept under ``answers``: a run that
    names the same folder again asks only for batches that have none there. Enriched rows
    are written once, so all outputs are of the same answers.
    """
    raw = io.require_columns(io.rename_columns(io.with_origin(io.read_comments(spark, path))))
    df = raw.withColumnsRenamed({"NPS": "nps_raw", "Nota": "nota", "Comentario Final": "comment"} | ({comment_id: "comment_id"} if comment_id else {}))
    cleaned = clean(df)
    io.require_columns(cleaned, ["nps", "nota", "comment"])
    others = light_columns(cleaned, "comment")
    passing, seen = quality.observe(cleaned, **{f"letters.{c}": has_letters(c) for c in others})
    rows = written(passing.withColumn(io.NUMBER, F.monotonically_increasing_id()), "cleaned")
    quality.require_size(rows, most=max_rows)
    lettered = [c for c in others if seen.get[f"letters.{c}"]]
    size = batch_size if usage is None else min(batch_size, batching.size_now(spark, usage, batch_size))
    numbered = io.with_row_number(rows.drop(quality.HASH), "__i")
    if comment_id is None:
        numbered = numbered.withColumn("comment_id", F.col("__i"))
    batches = batching.numbered_batches(normalize(numbered, lettered=lettered), "__i", size).drop("__i")
    out = written(enrich(analyze(batches, scorer, answers)), "results")
    return {"results": out, "summary": reports.run_summary(out), "metrics": reports.run_metrics(out)} | {f"{k}_check": v for k, v in quality.observed_reports(rows, seen).items()}
