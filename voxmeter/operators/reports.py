"""Aggregate reports over analysed comments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.constants import EMOTIONS, PAIN_CATEGORIES
from voxmeter.functions import churn, nps
from voxmeter.functions.emotion import label
from voxmeter.functions.pain import category
from voxmeter.operators.quantiles import at_ranks
from voxmeter.sources.io import drop_emotions, drop_internal

BINS = ["Bajo", "Medio", "Alto"]
#: Per pair (x, y): rows that have both, and sums over them of x, x * x, x * y, and of x that are no numbers.
MOMENTS = ["n", "x", "xx", "xy", "odd"]
#: Deviations from the mean, as a share of it, that are rounding.
EQUAL = 1e-15


def share(part: Column, whole: Column) -> Column:
    """Percent; null over nothing."""
    return F.try_divide(part * 100.0, whole)


def per_emotion(df: DataFrame, **aggregates) -> DataFrame:
    """One pass over the rows; one row per emotion with the named aggregates."""
    one = df.agg(*[f(F.col(e)).alias(f"{name}__{e}") for name, f in aggregates.items() for e in EMOTIONS])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(e).alias("emotion"), *[F.col(f"{n}__{e}").cast("double").alias(n) for n in aggregates]) for i, e in enumerate(EMOTIONS)])
    return one.select(F.inline(rows))


def emotion_distribution(df: DataFrame, top: int | None = None) -> DataFrame:
    out = per_emotion(df, mean=F.avg).select("ord", "emotion", (F.col("mean") * 100).alias("percentage")).orderBy(F.desc("percentage"), "ord").drop("ord")
    return out.limit(top) if top else out


def emotion_summary(df: DataFrame, high: float = 0.5) -> DataFrame:
    rows = per_emotion(df, mean=F.avg, top=F.max, high=lambda c: F.count_if(c > high))
    return rows.select(label("emotion").alias("emotion"), F.bround("mean", 3).alias("mean"), F.bround("top", 3).alias("max"), F.col("high").cast("long").alias("high_cases"), F.bround(F.col("mean") * 100, 1).alias("percentage"))


def value_shares(df: DataFrame, c: str, of_known: bool = False) -> DataFrame:
    """Count and percent of each value, of all rows or of those that have one."""
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    known = counts.where(F.col(c).isNotNull())
    total = (known if of_known else counts).agg(F.sum("n").alias("total"))
    # One row.
    return known.crossJoin(F.broadcast(total)).select(c, "n", share(F.col("n"), F.col("total")).alias("percentage"))


def nps_score(df: DataFrame, c: str = "nps_category") -> DataFrame:
    """NPS over the known categories, with the distribution over all."""
    n = {k: F.count_if(F.col(c) == k) for k in ("promoter", "passive", "detractor")}
    one = df.agg(F.count("*").alias("total_responses"), *[v.alias(k) for k, v in n.items()]).withColumn("valid_responses", F.col("promoter") + F.col("passive") + F.col("detractor"))
    score = F.coalesce(share(F.col("promoter") - F.col("detractor"), F.col("valid_responses")), F.lit(0.0))
    pct = lambda k: F.bround(F.coalesce(share(F.col(k), F.col("valid_responses")), F.lit(0.0)), 1).alias(f"{k}_pct")
    unknown = F.col("total_responses") - F.col("valid_responses")
    return one.select(F.bround(score, 1).alias("nps_score"), nps.interpretation(score).alias("interpretation"), "total_responses", "valid_responses", "promoter", "passive", "detractor", unknown.alias("unknown"), pct("promoter"), pct("passive"), pct("detractor"), F.bround(F.coalesce(share(unknown, F.col("total_responses")), F.lit(0.0)), 1).alias("unknown_pct"))


def raw_nps_score(df: DataFrame, c: str = "nps") -> DataFrame:
    """NPS from raw scores over all rows, those without one among the passives."""
    one = df.agg(F.count("*").alias("total"), F.count_if(F.col(c) >= 9).alias("promoters"), F.count_if(F.col(c) <= 6).alias("detractors"))
    score = F.coalesce(share(F.col("promoters") - F.col("detractors"), F.col("total")), F.lit(0.0))
    return one.select("promoters", "detractors", (F.col("total") - F.col("promoters") - F.col("detractors")).alias("passives"), score.alias("nps_score"), nps.chart_interpretation(score).alias("interpretation"))


def churn_bins(df: DataFrame, denominator: str = "all", c: str = "churn_risk") -> DataFrame:
    """Counts of the three bins, empty ones too. denominator: all rows, known values, or binned values."""
    b = churn.bin_label(F.col(c))
    one = df.agg(F.count("*").alias("all"), F.count(c).alias("known"), F.count(b).alias("binned"), *[F.count_if(b == x).alias(x) for x in BINS])
    rows = F.array(*[F.struct(F.lit(x).alias("bin"), F.col(x).alias("n"), share(F.col(x), F.col(denominator)).alias("percentage")) for x in BINS])
    return one.select(F.inline(rows))


def churn_distribution(df: DataFrame, c: str = "churn_risk") -> DataFrame:
    """Shares of low, medium and high, mean, upper median, least and greatest."""
    own, n = churn.category(F.col(c)), F.count(c)
    one = df.agg(
        *[F.bround(share(F.count_if((own == k) & F.col(c).isNotNull()), n), 1).alias(f"{k}_pct") for k in ("low", "medium", "high")],
        F.bround(F.avg(c), 3).alias("mean"),
        F.bround(F.min(c), 3).alias("min"),
        F.bround(F.max(c), 3).alias("max"),
    )
    median = at_ranks(df, F.col(c), {"median": lambda n: F.floor(n / 2)}, [])
    # One row each; without a value there is no median.
    return one.join(F.broadcast(median), F.lit(True), "left").withColumn("median", F.bround("median", 3)).drop("n")


def churn_headlines(df: DataFrame, c: str = "churn_risk", high: float = 0.7) -> DataFrame:
    n_high = F.count_if(F.col(c) > high)
    return df.agg(F.avg(c).alias("mean_churn"), n_high.alias("high_count"), share(n_high, F.count("*")).alias("high_pct"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows that have both; null for constants and empty pairs, NaN where a value is.

    A task sends on one row: matrices of products of its rows, taken about the columns' means,
    of which those of all tasks are added up.
    """
    k, numbers = len(columns), df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    # One row. A mean that is no number, for infinite values, is none.
    means = [m if m is not None and np.isfinite(m) else 0.0 for m in numbers.agg(*[F.avg(real(c)) for c in numbers.columns]).first()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - means
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            odd = np.isnan(x) & (there > 0)
            x = np.where(np.isnan(x), 0.0, x)
            sums += [there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x, odd.astype(float).T @ there]
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()]) for m in sums], names=MOMENTS)

    parts = numbers.mapInArrow(task, ", ".join(f"{m} array<double>" for m in MOMENTS)).select(F.posexplode(F.arrays_zip(*MOMENTS)).alias("at", "m"))
    total = parts.groupBy("at").agg(*[F.sum(f"m.{m}").alias(m) for m in MOMENTS])
    pairs = df.sparkSession.createDataFrame([(i * k + j, j * k + i, a, b, means[i], means[j]) for (i, a), (j, b) in combinations(enumerate(columns), 2)], "ij int, ji int, a string, b string, ma double, mb double")
    both = pairs.join(total.withColumnRenamed("at", "ij"), "ij").join(total.select(F.col("at").alias("ji"), F.col("x").alias("y"), F.col("xx").alias("yy"), F.col("odd").alias("odd_y")), "ji")
    n = F.col("n")
    # What is left of rounding where all values are equal is no variance.
    spread = lambda squares, s, mean: F.when(squares - s * s / n > n * F.pow(F.abs(mean) * EQUAL, 2), squares - s * s / n)
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread(F.col("xx"), F.col("x"), F.col("ma")) * spread(F.col("yy"), F.col("y"), F.col("mb")))
    return both.select("a", "b", F.when(n == 0, None).when(F.col("odd") + F.col("odd_y") > 0, F.lit(float("nan"))).otherwise(r).alias("r"))


def exploded_points(df: DataFrame, points: str = "pain_points", key: str = "comment_id") -> DataFrame:
    return df.select(key, F.posexplode(points).alias("pos", "pain_point"))


def top_pain_points(df: DataFrame, n: int = 10, points: str = "pain_points", key: str = "comment_id") -> DataFrame:
    """The n commonest pain points, ties by who was seen first."""
    seen = exploded_points(df, points, key).groupBy("pain_point").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(n).select("pain_point", "n")


def pain_insights(df: DataFrame, points: str = "pain_points", key: str = "comment_id") -> DataFrame:
    """Per category: count, percent and the first three examples. Each task keeps three examples of a category."""
    rows = exploded_points(df, points, key).withColumn("category", category(F.col("pain_point")))
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    # The first three (key, pos) of each category: three rounds of a minimum, each reduced before its shuffle.
    first = rows.groupBy("category").agg(F.min(F.struct(key, "pos", "pain_point")).alias("e1"))
    left = rows.join(F.broadcast(first), "category")
    second = left.where(F.struct(key, "pos", "pain_point") > F.col("e1")).groupBy("category").agg(F.min(F.struct(key, "pos", "pain_point")).alias("e2"))
    left = rows.join(F.broadcast(second), "category")
    third = left.where(F.struct(key, "pos", "pain_point") > F.col("e2")).groupBy("category").agg(F.min(F.struct(key, "pos", "pain_point")).alias("e3"))
    order = F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(PAIN_CATEGORIES)], F.lit(len(PAIN_CATEGORIES)))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(first), "category").join(F.broadcast(second), "category", "left").join(F.broadcast(third), "category", "left").crossJoin(F.broadcast(total))
    examples = F.array_compact(F.array("e1.pain_point", "e2.pain_point", "e3.pain_point"))
    return out.select("category", "n", F.bround(share(F.col("n"), F.col("total")), 1).alias("percentage"), F.array_join(examples, "|").alias("examples"), "total", order.alias("ord"))


def most_affected(insights: DataFrame) -> DataFrame:
    return insights.agg(F.max("total").alias("total"), F.min_by("category", F.struct((-F.col("n")).alias("n"), "ord")).alias("most_affected"))


def nps_opportunities(df: DataFrame) -> DataFrame:
    """One row over nps_category, alignment and alignment_score."""
    cat = F.col("nps_category")
    one = df.agg(
        F.count("*").alias("total_analyzed"),
        *[F.count_if(cat == k).alias(f"{k}s") for k in ("promoter", "passive", "detractor")],
        F.count_if((cat == "passive") & (F.col("alignment") == "misaligned")).alias("passive_promotion"),
        F.count_if((cat == "detractor") & (F.col("alignment_score") < 0.7)).alias("detractor_recovery"),
    )
    # Fixed texts.
    actions = F.array_compact(F.array(F.when(F.try_divide("detractors", "total_analyzed") > 0.3, "Address detractor concerns - over 30% detractor rate"), F.when(F.try_divide("passives", "total_analyzed") > 0.5, "Focus on passive engagement - large neutral segment")))
    return one.withColumn("priority_actions", F.array_join(actions, "|"))


def run_summary(df: DataFrame) -> DataFrame:
    top = F.array_sort(F.array(*[F.struct((-F.col(f"m_{e}")).alias("v"), F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(EMOTIONS)]))
    one = df.agg(F.count("*").alias("total"), F.avg("nps").alias("mean_nps"), F.count_if(F.col("churn_risk") > 0.7).alias("high_churn"), *[F.avg(e).alias(f"m_{e}") for e in EMOTIONS])
    return one.select("total", F.lit(len(EMOTIONS)).alias("n_emotions"), "mean_nps", "high_churn", F.array_join(F.transform(F.slice(top, 1, 5), lambda s: s["e"]), ",").alias("top_emotions"))


def run_metrics(df: DataFrame) -> DataFrame:
    """Emotion percents (two decimals), NPS shares and churn shares of the known ones, as (metric, name, value)."""
    emotions = per_emotion(df, mean=F.avg).select(F.lit("emotion").alias("metric"), F.col("emotion").alias("name"), F.bround(F.col("mean") * 100, 2).alias("value"))
    by_nps = value_shares(df, "nps_category", of_known=True).select(F.lit("nps").alias("metric"), F.col("nps_category").alias("name"), F.col("percentage").alias("value"))
    by_churn = churn_bins(df, "binned").select(F.lit("churn").alias("metric"), F.col("bin").alias("name"), F.col("percentage").alias("value"))
    return emotions.unionByName(by_nps).unionByName(by_churn)


def report_bundle(df: DataFrame, emotions: bool = True, analysis: bool = True, raw: bool = False, summary: bool = True) -> dict[str, DataFrame]:
    """The export datasets by name, as the flags ask."""
    out = {}
    if analysis:
        own = drop_internal(df, raw)
        out["Analisis_Completo"] = own if emotions else drop_emotions(own)
    if emotions and summary:
        out["Resumen_Emociones"] = emotion_summary(df)
    if summary:
        out |= {"Resumen_Analisis": run_summary(df), "Resumen_NPS": value_shares(df, "nps_category"), "Resumen_Churn": churn_bins(df, "known")}
    return out
