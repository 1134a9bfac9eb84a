"""Churn risk: base value, context, factors, and the customer-level columns built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmeter.constants import CHURN_HIGH, CHURN_MEDIUM, RISK_NEGATIVE, RISK_POSITIVE
from voxmeter.functions.emotion import clamp, mean_of, total
from voxmeter.functions.text import churn_keywords, contains_any


def base(c: Column, default: float = 0.5) -> Column:
    return clamp(F.coalesce(c.cast("string").try_cast("double"), F.lit(default)))


def nps_risk(nps: Column) -> Column:
    return F.when(nps.isNull(), 0.0).when(nps <= 6, 0.2).when(nps <= 8, 0.1).otherwise(-0.1)


def category(c: Column) -> Column:
    return F.when(c < 0.3, "low").when(c < 0.7, "medium").otherwise("high")


def factors(comment: Column, sentiment: Column, n_pains: Column) -> Column:
    v = F.lower(comment)
    several = total([(F.col(e) > 0.6).cast("int") for e in RISK_NEGATIVE]) >= 2
    found = F.array_compact(
        F.array(
            F.when(contains_any(v, CHURN_HIGH), "explicit_cancellation_intent"),
            F.when(contains_any(v, CHURN_MEDIUM), "dissatisfaction_indicators"),
            F.when(sentiment == "negative", "negative_sentiment"),
            F.when(several, "high_negative_emotions"),
            F.when(mean_of(RISK_POSITIVE) < 0.2, "low_positive_emotions"),
            F.when(n_pains >= 3, "multiple_pain_points"),
        )
    )
    return F.when(F.coalesce(comment, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def with_context(churn: Column, comment: Column, nps: Column) -> Column:
    """Base risk, keywords and NPS risk weighted into one probability, with its parts."""
    b, k, n = base(churn), churn_keywords(comment), nps_risk(nps)
    p = clamp(b * 0.6 + k * 0.3 + n * 0.1)
    return F.struct(p.alias("probability"), category(p).alias("category"), b.alias("base_risk"), k.alias("keyword_risk"), n.alias("nps_risk"))


def bin_label(c: Column) -> Column:
    """(0, .3] Bajo, (.3, .7] Medio, (.7, 1] Alto; 0 and null have none."""
    return F.when((c > 0) & (c <= 0.3), "Bajo").when((c > 0.3) & (c <= 0.7), "Medio").when((c > 0.7) & (c <= 1), "Alto")


def customer_risk(nps_category: Column, churn: Column, n_pains: Column) -> Column:
    d, p = nps_category == "detractor", nps_category == "passive"
    return F.when(d & (churn > 0.7), "CRITICAL").when(d | (churn > 0.6), "HIGH").when(p & (n_pains > 2), "MEDIUM").when(p | (churn > 0.4), "LOW").otherwise("MINIMAL")


def retention_priority(nps_category: Column, churn: Column, n_pains: Column) -> Column:
    start = F.when(nps_category == "detractor", 8).when(nps_category == "passive", 5).when(nps_category == "promoter", 2).otherwise(6)
    return F.greatest(F.lit(1), F.least(F.lit(10), start + F.floor(churn * 3).cast("int") + F.least(F.lit(2), n_pains)))
