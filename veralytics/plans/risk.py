"""Queries over risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import risk as R
from veralytics.plans.registry import query
from veralytics.plans.scoring import raw_scores
from veralytics.sources.fixtures import AS_OF_ORDERS, Tables


def exposures(t: Tables) -> DataFrame:
    return R.simulate_entity(raw_scores(t), t.domains)


@query("wrong_decision_rate", "SELECT domain, entity, wrong_decision_rate FROM {ox_risk}")
def _(t: Tables) -> DataFrame:
    rate = R.wrong_decision_rate(F.col("staleness_level"), F.col("staleness_score"))
    return raw_scores(t).select("domain", "entity", rate.alias("wrong_decision_rate"))


@query(
    "simulate_entity",
    "SELECT domain, entity, decisions_in_window, wrong_decision_rate, decisions_at_risk, avg_cost_usd, estimated_exposure_usd FROM {ox_risk}",
)
def _(t: Tables) -> DataFrame:
    return exposures(t).select(
        "domain", "entity", "decisions_in_window", "wrong_decision_rate", "decisions_at_risk", "avg_cost_usd", "estimated_exposure_usd"
    )


@query(
    "portfolio_risk",
    """SELECT *, CASE WHEN total_exposure_usd < 100000 THEN 'A' WHEN total_exposure_usd < 500000 THEN 'B' WHEN total_exposure_usd < 1000000 THEN 'C'
        WHEN total_exposure_usd < 5000000 THEN 'D' ELSE 'F' END AS risk_grade
    FROM (SELECT round(sum(estimated_exposure_usd), 2) AS total_exposure_usd, CAST(sum(decisions_at_risk) AS BIGINT) AS total_decisions_at_risk,
      count(*) FILTER (staleness_level = 'CRITICAL') AS critical_entities, count(*) FILTER (staleness_level = 'STALE') AS stale_entities FROM {ox_risk})""",
)
def _(t: Tables) -> DataFrame:
    return R.portfolio_risk(exposures(t))


@query(
    "portfolio_entities",
    "SELECT domain, entity, estimated_exposure_usd FROM {ox_risk} WHERE staleness_level = 'CRITICAL'",
)
def _(t: Tables) -> DataFrame:
    return R.entities_at(exposures(t), "CRITICAL")


@query("domain_breakdown", "SELECT domain, round(sum(estimated_exposure_usd), 2) AS exposure_usd FROM {ox_risk} GROUP BY domain")
def _(t: Tables) -> DataFrame:
    return R.domain_breakdown(exposures(t))


@query(
    "historical_exposure",
    f"""SELECT CAST(CAST(date_trunc('week', decided_at) AS DATE) AS STRING) AS week, domain, CAST(sum(risk_cents) AS BIGINT) AS realized_cents
    FROM {{fx_decisions}} WHERE decided_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return R.historical_exposure(t["fx_decisions"], AS_OF_ORDERS).withColumn("week", F.col("week").cast("string"))
