"""Data-quality reports, validation messages, and the quality of inferred values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxmeter.constants import LONG_COMMENT, MAX_ROWS, MIN_COMMENT, MIN_ROWS
from voxmeter.functions.text import is_spanish, normalization_stats, strip
from voxmeter.operators.quantiles import percentiles
from voxmeter.operators.reports import share


def require_size(df: DataFrame, least: int = MIN_ROWS, most: int | None = MAX_ROWS) -> DataFrame:
    """The table, or an error if it has too few rows, or too many where a limit is set."""
    if most is None and least <= 1:
        n = 0 if df.isEmpty() else 1
    else:
        n = df.limit(max(least, most + 1) if most is not None else least).count()  # no more rows are needed to know
    if n < least or (most is not None and n > most):
        raise ValueError(f"{'no' if not n else 'too few' if n < least else 'too many'} rows, allowed are {least} to {most}")
    return df


def cleaning_report(before: DataFrame, after: DataFrame, comment: str = "comment") -> DataFrame:
    b = before.agg(F.count("*").alias("rows_before"))
    length = F.length(comment)
    a = after.agg(F.count("*").alias("rows_after"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.bround(F.avg(length), 1).alias("mean_length"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in after.columns])
    removed = F.col("rows_before") - F.col("rows_after")
    return b.crossJoin(a).withColumns({"rows_removed": removed, "removed_pct": F.bround(share(removed, F.col("rows_before")), 2)})


def nps_counts(c: str) -> dict[str, Column]:
    return {"total": F.count("*"), "missing": F.count_if(F.col(c).isNull()), "out_of_range": F.count_if((F.col(c) < 0) | (F.col(c) > 10))}


def rating_counts(c: str) -> dict[str, Column]:
    return {"total": F.count("*"), "missing": F.count_if(F.col(c).isNull()), "negative": F.count_if(F.col(c) < 0)}


def comment_counts(c: str) -> dict[str, Column]:
    n = F.length(c)
    return {"total": F.count("*"), "missing": F.count_if(F.col(c).isNull()), "short": F.count_if(n < MIN_COMMENT), "long": F.count_if(n > LONG_COMMENT)}


def named(counts: dict[str, Column], prefix: str = "") -> list[Column]:
    return [v.alias(f"{prefix}{k}") for k, v in counts.items()]


def validate_nps(df: DataFrame, c: str = "nps") -> DataFrame:
    """Counts, and the status of each check: error, warning or ok."""
    return nps_report(df.agg(*named(nps_counts(c)), F.count_distinct(c).alias("distinct_values")))


def nps_report(one: DataFrame) -> DataFrame:
    pct = share(F.col("missing"), F.col("total"))
    return one.select("total", "missing", F.bround(pct, 1).alias("missing_pct"), "out_of_range", "distinct_values", F.when(pct > 50, "error").when(pct > 0, "warning").otherwise("ok").alias("missing_status"), (pct == 100).alias("all_missing"), F.when(F.col("out_of_range") > 0, "error").otherwise("ok").alias("range_status"), F.when((F.col("missing") < F.col("total")) & (F.col("distinct_values") < 3), "warning").otherwise("ok").alias("diversity_status"))


def validate_rating(df: DataFrame, c: str = "nota") -> DataFrame:
    return rating_report(df.agg(*named(rating_counts(c))))


def rating_report(one: DataFrame) -> DataFrame:
    pct = share(F.col("missing"), F.col("total"))
    return one.select("total", "missing", F.bround(pct, 1).alias("missing_pct"), "negative", F.when(pct > 30, "warning").otherwise("ok").alias("missing_status"), F.when(F.col("negative") > 0, "warning").otherwise("ok").alias("range_status"))


#: log2 of a sketch's slots: an estimate's standard error is 1.04 / sqrt(2**14), below one percent.
SLOTS = 14


def about_distinct(c: Column) -> Column:
    """How many distinct values, by a sketch that each task keeps and sends on: nothing else is shuffled."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, SLOTS)), F.lit(0)).cast("long")


def validate_comments(df: DataFrame, c: str = "comment", exact: bool = True) -> DataFrame:
    """Distinct comments are counted in a pass of their own, whose shuffle carries one row per task and text; or estimated, to about one percent of them, in the same pass."""
    # A null comment has a hash too.
    distinct = F.count_distinct(F.xxhash64(c)) if exact else about_distinct(F.xxhash64(c))
    repeated = F.greatest(F.lit(0), F.count(c) - distinct + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0)))
    return comment_report(df.agg(*named(comment_counts(c)), repeated.alias("duplicates")))


def comment_report(one: DataFrame) -> DataFrame:
    valid = F.col("total") - F.col("missing")
    pct, dup = share(F.col("missing"), F.col("total")), share(F.col("duplicates"), valid)
    return one.select("total", "missing", F.bround(pct, 1).alias("missing_pct"), "short", F.bround(share(F.col("short"), valid), 1).alias("short_pct"), "long", "duplicates", F.bround(dup, 1).alias("duplicate_pct"), F.when(pct > 10, "error").when(pct > 0, "warning").otherwise("ok").alias("missing_status"), F.when(dup > 5, "many").when(dup > 0, "some").otherwise("none").alias("duplicate_status"))


#: Hash of a comment, kept for counting repeated ones.
HASH = "__hash"


def observe(df: DataFrame, nps: str = "nps", rating: str = "nota", comment: str = "comment", **more: Column) -> tuple[DataFrame, Observation]:
    """``df`` with the counts of its reports, and those named in ``more``, taken as its rows pass by; known after the first action."""
    seen = Observation()
    counts = named(nps_counts(nps), "nps.") + named(rating_counts(rating), "rating.") + named(comment_counts(comment), "comment.") + named(more)
    return df.withColumn(HASH, F.xxhash64(comment)).observe(seen, *counts), seen


def observed_reports(written: DataFrame, seen: Observation, nps: str = "nps") -> dict[str, DataFrame]:
    """The three reports from what was observed as ``written`` was written; only distinct values are counted from its columns."""
    got = seen.get
    of = lambda kind: [F.lit(v).cast("long").alias(k.split(".")[1]) for k, v in got.items() if k.startswith(f"{kind}.")]
    distinct = written.agg(F.count_distinct(nps).alias("values"), F.count_distinct(HASH).alias("hashes"))
    no_null = F.when(F.col("missing") > 0, 1).otherwise(0)
    one = lambda *columns: written.sparkSession.range(1).select(*columns)
    return {
        "nps": nps_report(distinct.select(*of("nps"), F.col("values").alias("distinct_values"))),
        "rating": rating_report(one(*of("rating"))),
        "comment": comment_report(distinct.select("hashes", *of("comment")).withColumn("duplicates", F.col("total") - F.col("missing") - F.col("hashes") + no_null)),
    }


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles, greatest, distinct values and nulls of each column. Distinct values are counted, or estimated to about one percent."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "nulls": lambda c: F.count_if(F.col(c).isNull())}
    one = df.agg(*[f(c).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").cast("long" if s in ("n", "nulls") else "double").alias(s) for s in stats]) for c in columns])))
    # One row per column and value; equal ones of a task are one before they are shuffled.
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    distinct = long.groupBy("column", "v").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("distinct_values")) if exact else long.groupBy("column").agg(about_distinct(F.xxhash64("v")).alias("distinct_values"))
    quartiles = percentiles(long, F.col("v"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"])
    return out.join(quartiles, "column", "left").join(distinct, "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long")))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))


def comment_profile(df: DataFrame, c: str = "comment") -> DataFrame:
    n = F.length(c)
    return df.agg(F.count(c).alias("total_comments"), F.bround(F.avg(n), 1).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(strip(F.col(c)) == "").alias("empty_comments"), F.when(F.avg(is_spanish(F.col(c)).cast("int")) > 0.7, "Spanish").otherwise("Mixed/Other").alias("language"))


def inference_stats(df: DataFrame, original: str, final: str) -> DataFrame:
    n = F.count("*")
    before, after = share(F.count(original), n), share(F.count(final), n)
    return df.agg(n.alias("total_rows"), F.count(original).alias("original_valid"), (n - F.count(original)).alias("needing_inference"), F.count(final).alias("final_valid"), before.alias("before_pct"), after.alias("after_pct"), (after - before).alias("improvement_points"))


def inference_quality(df: DataFrame, confidence: str, nps: str) -> DataFrame:
    c = F.col(confidence)
    one = df.agg(F.count(c).alias("n"), F.count_if(c > 0.75).alias("high"), F.count_if(c.between(0.5, 0.75)).alias("medium"), F.avg(c).alias("quality_score"), F.coalesce(F.stddev_pop(nps), F.lit(0.0)).alias("nps_std"))
    high, some = F.try_divide("high", "n"), F.try_divide(F.col("high") + F.col("medium"), F.col("n"))
    rating = F.when(F.col("n") == 0, "NO_INFERENCES").when((F.col("quality_score") > 0.7) & (high > 0.6), "EXCELLENT").when((F.col("quality_score") > 0.5) & (some > 0.7), "GOOD").otherwise("ACCEPTABLE")
    one = one.withColumns({"low": F.col("n") - F.col("high") - F.col("medium"), "rating": rating})
    # Fixed texts.
    advice = F.array_compact(F.array(F.when(F.col("quality_score") < 0.5, "Consider improving emotion analysis prompt for clearer emotional signals"), F.when(F.col("rating") == "ACCEPTABLE", "Review emotion weights - may need calibration for your domain")))
    return one.withColumn("recommendations", F.array_join(advice, "|"))


def normalization_summary(df: DataFrame, original: str, normal: str) -> DataFrame:
    a, b = F.col(original), F.col(normal)
    changed = F.count_if(a != b)
    return df.agg(F.count("*").alias("total"), changed.alias("changed"), share(changed, F.count("*")).alias("changed_pct"), F.avg(F.length(a)).alias("mean_before"), F.avg(F.length(b)).alias("mean_after"), (F.avg(F.length(b)) - F.avg(F.length(a))).alias("delta"))


def with_normalization_stats(df: DataFrame, original: str, normal: str) -> DataFrame:
    return df.withColumn("stats", normalization_stats(F.col(original), F.col(normal)))


def grade(value: Column, good: float, fair: float) -> Column:
    return F.when(value > good, "success").when(value > fair, "warning").otherwise("error")


def ingestion_grade(n_rows: Column) -> Column:
    return F.when(n_rows > 100, "good").when(n_rows > 0, "minimal").otherwise("error")


def completion_grade(sla: Column, charts: Column, export: Column) -> Column:
    return F.when(sla & charts & export, "success").when(charts | export, "warning").otherwise("error")


def preview_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("nps").alias("mean_nps"), F.avg(F.length("comment")).alias("mean_length"), F.avg("nota").alias("mean_rating"))
