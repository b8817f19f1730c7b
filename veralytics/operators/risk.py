"""Exposure of stale facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.functions import clock


def wrong_decision_rate(level: Column, score: Column) -> Column:
    """Base rate of the level, scaled by 0.7 + 0.3 * score."""
    base = F.lit(C.WRONG_RATE_DEFAULT)
    for name, rate in C.WRONG_RATE.items():
        base = F.when(level == name, F.lit(rate)).otherwise(base)
    return F.round(base * (0.7 + 0.3 * score), 4)


def simulate_entity(scores: DataFrame, domains: DataFrame, window_days: int = 30) -> DataFrame:
    """Decisions in the window, decisions at risk and exposure of each score."""
    impact = domains.select("domain", F.col("decisions_per_month").alias("_monthly"), F.col("cost_usd").alias("_cost"))
    monthly = F.coalesce("_monthly", F.lit(C.DEFAULT_DECISIONS_PER_MONTH))
    in_window = F.floor(monthly * window_days / 30).cast("bigint")
    joined = (
        scores.join(impact, "domain", "left")
        .withColumn("decisions_in_window", in_window)
        .withColumn("wrong_decision_rate", wrong_decision_rate(F.col("staleness_level"), F.col("staleness_score")))
        .withColumn("decisions_at_risk", F.floor(F.col("decisions_in_window") * F.col("wrong_decision_rate")).cast("bigint"))
        .withColumn("avg_cost_usd", F.coalesce("_cost", F.lit(C.DEFAULT_COST_USD)))
    )
    return joined.withColumn(
        "estimated_exposure_usd", F.round(F.col("decisions_at_risk") * F.col("avg_cost_usd"), 2)
    ).drop("_monthly", "_cost")


def risk_grade(total: Column) -> Column:
    """A to F by total exposure."""
    grade = F.lit(C.WORST_GRADE)
    for name, limit in reversed(C.GRADE_LIMITS):
        grade = F.when(total < limit, F.lit(name)).otherwise(grade)
    return grade


def portfolio_risk(exposures: DataFrame) -> DataFrame:
    """Totals and grade in one row.

    The entities behind the counts can be any number of rows: ``entities_at`` lists them.
    """
    totals = exposures.agg(
        F.coalesce(F.round(F.sum("estimated_exposure_usd"), 2), F.lit(0.0)).alias("total_exposure_usd"),
        F.coalesce(F.sum("decisions_at_risk"), F.lit(0)).alias("total_decisions_at_risk"),
        F.count_if(F.col("staleness_level") == "CRITICAL").alias("critical_entities"),
        F.count_if(F.col("staleness_level") == "STALE").alias("stale_entities"),
    )
    return totals.withColumn("risk_grade", risk_grade(F.col("total_exposure_usd")))


def entities_at(exposures: DataFrame, level: str) -> DataFrame:
    """The entities of one level, one per row."""
    return exposures.filter(F.col("staleness_level") == level).select("domain", "entity", "estimated_exposure_usd")


def domain_breakdown(exposures: DataFrame) -> DataFrame:
    """Exposure per domain."""
    return exposures.groupBy("domain").agg(F.round(F.sum("estimated_exposure_usd"), 2).alias("exposure_usd"))


def historical_exposure(
    decisions: DataFrame, as_of: datetime | str, days_back: int = 90, domain: str | None = None
) -> DataFrame:
    """Realized risk per Monday week and domain after the cutoff."""
    recent = decisions.filter(F.col("decided_at") >= clock.moment(as_of) - clock.days(days_back))
    if domain is not None:
        recent = recent.filter(F.col("domain") == domain)
    day = F.col("decided_at").cast("date")
    monday = F.date_sub(day, F.weekday(day))
    return recent.groupBy(monday.alias("week"), "domain").agg(F.sum("risk_cents").alias("realized_cents"))
