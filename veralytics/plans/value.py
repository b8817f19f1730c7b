"""Queries over the value ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import value as V
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, AS_OF_ORDERS, ORACLE_PARTS, Tables

_CUT = f"decided_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 30 DAY"

ORACLE_PARTS["ox_linked"] = """
SELECT * FROM {fx_outcomes} o WHERE EXISTS (SELECT 1 FROM {fx_injections} i WHERE i.domain = o.domain
  AND o.outcome_ts >= i.injected_at AND o.outcome_ts <= i.injected_at + INTERVAL 4 HOUR)
"""
ORACLE_PARTS["ox_counts"] = f"""
SELECT d.domain, CASE WHEN l.n > 0 THEN l.n ELSE coalesce(x.n, 0) END AS total_decisions
FROM {{fx_domains}} d LEFT JOIN (SELECT domain, count(*) AS n FROM {{ox_linked}} GROUP BY 1) l USING (domain)
LEFT JOIN (SELECT domain, count(*) AS n FROM {{fx_decisions}} WHERE {_CUT} GROUP BY 1) x USING (domain)
"""
ORACLE_PARTS["ox_exposure"] = """
SELECT *, round(financial_exposure_usd * 0.65, 2) AS recovery_potential_usd FROM (
  SELECT domain, risk_category, 30 AS failure_period_days, total_decisions, CAST(floor(total_decisions * CAST(0.15 AS DOUBLE)) AS BIGINT) AS estimated_bad_decisions,
    CAST(floor(total_decisions * CAST(0.15 AS DOUBLE)) * 50000 AS DOUBLE) AS financial_exposure_usd
  FROM {ox_counts} JOIN {fx_domains} USING (domain))
"""
_RECOVERY = """
SELECT {key} decisions_before, decisions_after, round(b, 2) AS avg_value_before, round(a, 2) AS avg_value_after, round(a - b, 2) + 0 AS value_delta,
  greatest(round((a - b) * decisions_after, 2), 0) + 0 AS total_recovery_usd, greatest(round(round((a - b) * decisions_after, 2) / 5000, 2), 0) + 0 AS roi_multiplier
FROM (SELECT {key} count(*) FILTER (NOT correction_applied) AS decisions_before, count(*) FILTER (correction_applied) AS decisions_after,
  coalesce(CAST(sum(value_cents) FILTER (NOT correction_applied) AS DOUBLE) / 100 / nullif(count(*) FILTER (NOT correction_applied), 0), 0) AS b,
  coalesce(CAST(sum(value_cents) FILTER (correction_applied) AS DOUBLE) / 100 / nullif(count(*) FILTER (correction_applied), 0), 0) AS a
  FROM {{fx_outcomes}} {group})
"""
ORACLE_PARTS["ox_recovery"] = _RECOVERY.replace("{key}", "domain,").replace("{group}", "GROUP BY domain").replace("{{", "{").replace("}}", "}")
ORACLE_PARTS["ox_recovery_all"] = _RECOVERY.replace("{key}", "").replace("{group}", "").replace("{{", "{").replace("}}", "}")
ORACLE_PARTS["ox_value"] = """
SELECT d.domain, domain_id, coalesce(financial_exposure_usd, 0) AS financial_exposure_usd, coalesce(total_recovery_usd, 0) AS total_recovery_usd,
  coalesce(roi_multiplier, 0) AS roi_multiplier
FROM {fx_domains} d LEFT JOIN {ox_exposure} USING (domain) LEFT JOIN {ox_recovery} USING (domain)
"""


def linked(t: Tables) -> DataFrame:
    return V.injection_outcome_link(t["fx_injections"], t["fx_outcomes"])


def counts(t: Tables) -> DataFrame:
    return V.count_decisions(t.domains, linked(t), t["fx_decisions"], AS_OF_ORDERS)


def exposures(t: Tables) -> DataFrame:
    return V.exposure(counts(t))


def by_domain(t: Tables) -> DataFrame:
    return V.value_by_domain(t.domains, exposures(t), V.recovery_value(t["fx_outcomes"], ["domain"]))


@query("injection_outcome_link", "SELECT * FROM {ox_linked}")
def _(t: Tables) -> DataFrame:
    return linked(t)


@query("count_decisions", "SELECT * FROM {ox_counts}")
def _(t: Tables) -> DataFrame:
    return counts(t)


@query(
    "exposure",
    "SELECT domain, total_decisions, risk_category, failure_period_days, estimated_bad_decisions, financial_exposure_usd, recovery_potential_usd FROM {ox_exposure}",
)
def _(t: Tables) -> DataFrame:
    return exposures(t)


@query("decisions_by_type", f"SELECT domain, decision_outcome, count(*) AS decisions FROM {{fx_decisions}} WHERE {_CUT} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return V.decisions_by_type(t["fx_decisions"], AS_OF_ORDERS)


@query(
    "risk_category",
    """SELECT decision_id, CASE WHEN domain IS NULL OR decision_outcome = 'P' THEN 'Limited' ELSE risk_category END AS risk_category
    FROM {fx_decisions} JOIN {fx_domains} USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    domain = F.when(F.col("decision_outcome") == "P", F.lit("unlisted")).otherwise(F.col("domain"))
    return V.risk_category(t["fx_decisions"].withColumn("domain", domain)).select("decision_id", "risk_category")


@query("recovery_value", "SELECT * FROM {ox_recovery}")
def _(t: Tables) -> DataFrame:
    return V.recovery_value(t["fx_outcomes"], ["domain"])


@query("recovery_value_total", "SELECT * FROM {ox_recovery_all}")
def _(t: Tables) -> DataFrame:
    return V.recovery_value(t["fx_outcomes"])


@query(
    "value_summary",
    """SELECT round(sum(financial_exposure_usd), 2) AS total_exposure_usd, round(sum(total_recovery_usd), 2) AS total_recovered_usd,
      round(sum(total_recovery_usd) - 5000 * count(*), 2) AS net_value_usd, arg_max(domain, roi_multiplier * 1000 - domain_id / 1000) AS top_domain FROM {ox_value}""",
)
def _(t: Tables) -> DataFrame:
    return V.value_summary(by_domain(t))


@query("value_by_domain", "SELECT * FROM {ox_value}")
def _(t: Tables) -> DataFrame:
    return by_domain(t)


@query(
    "tag_injection",
    """SELECT outcome_id, correction_applied OR domain IN (SELECT domain FROM {fx_injections}) AS correction_applied,
      NOT correction_applied AND domain IN (SELECT domain FROM {fx_injections}) AS tagged FROM {fx_outcomes}""",
)
def _(t: Tables) -> DataFrame:
    return V.tag_injection(t["fx_outcomes"], t["fx_injections"]).select("outcome_id", "correction_applied", "tagged")


@query(
    "tag_injection_window",
    """SELECT o.outcome_id, o.correction_applied OR l.outcome_id IS NOT NULL AS correction_applied, NOT o.correction_applied AND l.outcome_id IS NOT NULL AS tagged
    FROM {fx_outcomes} o LEFT JOIN {ox_linked} l USING (outcome_id)""",
)
def _(t: Tables) -> DataFrame:
    return V.tag_injection(t["fx_outcomes"], t["fx_injections"], hours=4).select("outcome_id", "correction_applied", "tagged")


@query(
    "value_event",
    """SELECT domain, 'VALUE_CALCULATED' AS event_type, financial_exposure_usd AS exposure_usd, estimated_bad_decisions AS bad_decisions,
      CASE WHEN risk_category = 'High' THEN 'WARNING' ELSE 'INFO' END AS severity FROM {ox_exposure}""",
)
def _(t: Tables) -> DataFrame:
    body = F.from_json("payload", "exposure_usd double, bad_decisions bigint")
    return V.value_event(exposures(t), AS_OF).withColumn("_p", body).select(
        "domain", "event_type", "_p.exposure_usd", "_p.bad_decisions", "severity"
    )


@query(
    "recovery_timeline",
    f"""SELECT CAST(CAST(outcome_ts AS DATE) AS STRING) AS day, domain, CAST(sum(value_cents) AS BIGINT) AS value_cents FROM {{fx_outcomes}}
    WHERE correction_applied AND outcome_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return V.recovery_timeline(t["fx_outcomes"], AS_OF).withColumn("day", F.col("day").cast("string"))


@query(
    "exposure_table",
    "SELECT domain, estimated_bad_decisions, financial_exposure_usd, risk_category FROM {ox_exposure}",
)
def _(t: Tables) -> DataFrame:
    return exposures(t).select("domain", "estimated_bad_decisions", "financial_exposure_usd", "risk_category")
