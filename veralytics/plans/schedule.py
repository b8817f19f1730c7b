"""Queries over schedules, expiry and notification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import dims
from veralytics.operators import schedule as H
from veralytics.plans.events import _INDUSTRY
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, AS_OF_DATE, ORACLE_PARTS, Tables

ORACLE_PARTS["ox_sched"] = f"""
SELECT *, CASE WHEN i IS NULL THEN false WHEN el IS NULL THEN true ELSE el >= i END AS due,
  CASE WHEN i IS NULL THEN 'manual only' WHEN el IS NULL THEN 'overdue — never run' WHEN greatest(i - el, 0) < 60 THEN 'due now'
    WHEN greatest(i - el, 0) < 3600 THEN 'in ' || CAST(CAST(floor((i - el) / 60) AS BIGINT) AS STRING) || ' min'
    ELSE 'in ' || CAST(CAST(floor((i - el) / 3600) AS BIGINT) AS STRING) || 'h ' || CAST(CAST(floor((i - el - floor((i - el) / 3600) * 3600) / 60) AS BIGINT) AS STRING) || 'm' END AS next_run
FROM (SELECT *, CASE schedule WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 END AS i,
  epoch(TIMESTAMP '{AS_OF}' - last_run) AS el FROM {{fx_sched}})
"""


def _plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    both = t["fx_sched"]
    return both.select("domain_key", "schedule"), both.filter(F.col("last_run").isNotNull()).select("domain_key", "last_run")


@query("due_domains", "SELECT domain_key, schedule, last_run FROM {ox_sched} WHERE due")
def _(t: Tables) -> DataFrame:
    return H.due_domains(*_plan(t), AS_OF)


@query("next_run", "SELECT domain_key, schedule, next_run FROM {ox_sched}")
def _(t: Tables) -> DataFrame:
    return H.next_run(*_plan(t), AS_OF)


@query(
    "status_table",
    """SELECT domain_key, CASE WHEN c_custkey IS NULL THEN split_part(domain_key, '__', 1) ELSE 'Company ' || c_name END AS company,
      CASE WHEN c_custkey IS NULL THEN domain_key ELSE 'Domain ' || event_type END AS domain, schedule, last_run IS NULL AS never, next_run, due AS due_now
    FROM {ox_sched} LEFT JOIN (SELECT DISTINCT 'co' || CAST(c_custkey AS STRING) || '__' || event_type AS domain_key, c_custkey, c_name, event_type
      FROM {customer} JOIN {events} ON user_id = c_custkey) USING (domain_key)""",
)
def _(t: Tables) -> DataFrame:
    labels = (
        t["events"].select("user_id", "event_type").distinct().join(t["customer"], F.col("user_id") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("co"), F.col("c_custkey").cast("string"), F.lit("__"), "event_type").alias("domain_key"),
            F.concat(F.lit("Company "), "c_name").alias("company_name"), F.concat(F.lit("Domain "), "event_type").alias("domain_name"),
        )
    )
    table = H.status_table(*_plan(t), labels, AS_OF)
    return table.withColumn("never", F.col("last_run") == "never").drop("last_run")


# The log of all probes: completed at the probe's own time.
@query(
    "recent_results",
    "SELECT domain AS domain_key, entity, probe_ts AS completed_at, model_belief FROM {fx_probes} ORDER BY probe_ts DESC, domain DESC, entity DESC LIMIT 50",
)
def _(t: Tables) -> DataFrame:
    log = t["fx_probes"].select(F.col("domain").alias("domain_key"), "entity", F.col("probe_ts").alias("completed_at"), "model_belief")
    return H.recent_results(log)


@query(
    "reprobe_requests",
    """SELECT domain, entity, staleness_level, staleness_score, 'reprobe_after_correction' AS triggered_by FROM {ox_probed}
    WHERE domain IN (SELECT domain FROM {fx_bus} WHERE event_type = 'REPROBE_REQUESTED')""",
)
def _(t: Tables) -> DataFrame:
    return H.reprobe_requests(t.bus, t.gold, t.domains, AS_OF).select(
        "domain", "entity", "staleness_level", "staleness_score", "triggered_by"
    )


ORACLE_PARTS["ox_alerts"] = f"""
SELECT * EXCLUDE (w), CASE WHEN level = 'EXPIRING' THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM (
  SELECT domain, entity, industry, expiry_date, days_until_expiry, recommended_action, w, CASE WHEN days_until_expiry < 0 THEN 'EXPIRED'
    WHEN days_until_expiry <= 7 THEN 'EXPIRING_SOON' WHEN days_until_expiry <= w THEN 'EXPIRING' END AS level
  FROM (SELECT *, date_diff('day', DATE '{AS_OF_DATE}', TRY_CAST(expiry_date AS DATE)) AS days_until_expiry,
    CASE industry WHEN 'Healthcare' THEN 60 WHEN 'Insurance' THEN 90 WHEN 'Retail' THEN 7 ELSE 30 END AS w FROM {{ox_current}}
    WHERE TRY_CAST(expiry_date AS DATE) IS NOT NULL)) WHERE level IS NOT NULL
"""


def alerts(t: Tables) -> DataFrame:
    return H.expiry_scan(t.gold, dims.industries(t.spark), dims.warn_days(t.spark), AS_OF_DATE)


@query("expiry_scan", "SELECT * FROM {ox_alerts}")
def _(t: Tables) -> DataFrame:
    return alerts(t)


@query(
    "expiry_events",
    "SELECT domain, entity, 'EXPIRY_ALERT' AS event_type, severity, level, severity = 'CRITICAL' AS requires_approval FROM {ox_alerts}",
)
def _(t: Tables) -> DataFrame:
    return H.expiry_events(alerts(t), AS_OF).select(
        "domain", "entity", "event_type", "severity", F.get_json_object("payload", "$.level").alias("level"), "requires_approval"
    )


@query(
    "expiry_approvals",
    """SELECT domain, entity, recommended_action || '_EXPIRED_RECORD' AS proposed_action, CASE recommended_action WHEN 'REMOVE' THEN 'Medium' ELSE 'Low' END AS risk_level,
      'pending' AS status FROM {ox_alerts} WHERE recommended_action IN ('REMOVE', 'UPDATE')""",
)
def _(t: Tables) -> DataFrame:
    return H.expiry_approvals(alerts(t), AS_OF).select("domain", "entity", "proposed_action", "risk_level", "status")


@query(
    "stale_action_queue",
    f"""SELECT domain, entity, industry, recommended_action, coalesce(nullif(expiry_date, ''), '—') AS expiry_date,
      date_diff('day', DATE '{AS_OF_DATE}', TRY_CAST(expiry_date AS DATE)) AS days_until_expiry, model_belief,
      coalesce(nullif(substring(staleness_reason, 1, 80), ''), '—') AS staleness_reason FROM {{ox_current}} WHERE recommended_action <> 'NONE'""",
)
def _(t: Tables) -> DataFrame:
    return H.stale_action_queue(t.gold, AS_OF_DATE)


ORACLE_PARTS["ox_notified"] = f"""
SELECT b.*, {_INDUSTRY} AS ind, time_bucket(INTERVAL 24 HOUR, event_ts, TIMESTAMP '1970-01-01') AS window_start FROM {{fx_bus}} b JOIN {{fx_domains}} USING (domain)
WHERE event_type IN ('EXPIRY_ALERT', 'PIPELINE_FAILURE_FOUND', 'DATA_CONTRACT_EXPIRY') OR (event_type = 'STALENESS_DETECTED' AND severity <> 'INFO')
"""


@query("notify_filter", "SELECT event_id, event_type, severity FROM {ox_notified}")
def _(t: Tables) -> DataFrame:
    return H.notify_filter(t.bus).select("event_id", "event_type", "severity")


@query(
    "digest",
    """SELECT window_start, ind AS industry, events, criticals, expiries, ind || ' — ' || CASE WHEN criticals + expiries = 0 THEN CAST(events AS STRING) || ' events'
      ELSE concat_ws(', ', CASE WHEN criticals > 0 THEN CAST(criticals AS STRING) || ' CRITICAL' END, CASE WHEN expiries > 0 THEN CAST(expiries AS STRING) || ' expiring' END) END AS subject
    FROM (SELECT window_start, ind, count(*) AS events, count(*) FILTER (severity = 'CRITICAL') AS criticals, count(*) FILTER (event_type = 'EXPIRY_ALERT') AS expiries
      FROM {ox_notified} GROUP BY 1, 2)""",
)
def _(t: Tables) -> DataFrame:
    return H.digest(t.bus, dims.industries(t.spark))


@query(
    "digest_lines",
    """SELECT window_start, ind AS industry, event_ts, event_id, CASE event_type
      WHEN 'EXPIRY_ALERT' THEN 'EXPIRY [' || severity || '] ' || domain || ' / ' || entity || ' | Expires: ' || CASE WHEN user_id % 5 = 0 THEN 'unknown (?' ELSE '2024-02-03 (' || CAST(n % 40 AS STRING) END
        || ' days) | Recommended action: ' || CASE WHEN user_id % 5 = 0 THEN 'REVIEW' ELSE 'REMOVE' END
      WHEN 'STALENESS_DETECTED' THEN 'STALE [' || severity || '] ' || domain || ' / ' || entity || ' | AI believes: ? | Warehouse: ? | ' || CAST(units AS STRING) || ' days stale'
      ELSE 'PIPELINE [' || severity || '] ' || dbt_model || ' | Failure: gap | Domain: ' || domain END AS line
    FROM {ox_notified} JOIN (SELECT domain, dbt_model FROM {fx_domains}) USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    return H.digest_lines(t.bus, dims.industries(t.spark))


@query(
    "notification_log",
    """SELECT event_id, event_type, ind AS industry, severity, CASE ind WHEN 'Retail' THEN 'a@example.com;b@example.com' ELSE 'all@example.com' END AS recipients FROM {ox_notified}""",
)
def _(t: Tables) -> DataFrame:
    groups = dims.fixed(
        t.spark, [("Retail", ["a@example.com", "b@example.com"]), ("Insurance", []), ("default", ["all@example.com"])],
        "industry string, recipients array<string>",
    )
    return H.notification_log(t.bus, dims.industries(t.spark), groups).select(
        "event_id", "event_type", "industry", "severity", "recipients"
    )
