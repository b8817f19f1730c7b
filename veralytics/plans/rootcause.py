"""Queries over run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.operators import rootcause as P
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables

ORACLE_PARTS["ox_recent_runs"] = f"SELECT * FROM {{fx_runs}} WHERE run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY"
ORACLE_PARTS["ox_failed"] = "SELECT dbt_model, max(run_timestamp) AS failed_at FROM {ox_recent_runs} WHERE status = 'failed' GROUP BY 1"
ORACLE_PARTS["ox_dropped"] = """
SELECT dbt_model, run_timestamp AS dropped_at, round((m - r) / m, 3) AS drop_fraction FROM (
  SELECT *, row_number() OVER (PARTITION BY dbt_model ORDER BY run_timestamp, run_id) AS rn FROM (
    SELECT *, median(CAST(rows_affected AS DOUBLE)) OVER (PARTITION BY dbt_model) AS m, CAST(rows_affected AS DOUBLE) AS r FROM {ox_recent_runs})
  WHERE m > 0 AND r < m * 0.7) WHERE rn = 1
"""
ORACLE_PARTS["ox_drifted"] = """
SELECT dbt_model, min(run_timestamp) AS drifted_at FROM (
  SELECT *, first_value(schema_version) OVER (PARTITION BY dbt_model ORDER BY run_timestamp, run_id) AS f FROM {ox_recent_runs})
WHERE schema_version <> f GROUP BY 1
"""
ORACLE_PARTS["ox_gap"] = """
SELECT dbt_model, min(run_timestamp) AS gap_at FROM (
  SELECT *, lead(run_timestamp) OVER (PARTITION BY dbt_model ORDER BY run_timestamp) AS nx FROM {ox_recent_runs})
WHERE nx - run_timestamp > INTERVAL 24 HOUR GROUP BY 1
"""
ORACLE_PARTS["ox_detected"] = """
SELECT m.dbt_model, CASE WHEN failed_at IS NOT NULL THEN 'hard_failure' WHEN dropped_at IS NOT NULL THEN 'silent_drop'
    WHEN drifted_at IS NOT NULL THEN 'schema_drift' WHEN gap_at IS NOT NULL THEN 'gap' ELSE 'unknown' END AS failure_type,
  coalesce(failed_at, dropped_at, drifted_at, gap_at) AS failure_timestamp, CASE WHEN failed_at IS NULL THEN drop_fraction END AS drop_fraction
FROM (SELECT DISTINCT dbt_model FROM {fx_runs}) m LEFT JOIN {ox_failed} USING (dbt_model) LEFT JOIN {ox_dropped} USING (dbt_model)
LEFT JOIN {ox_drifted} USING (dbt_model) LEFT JOIN {ox_gap} USING (dbt_model)
"""
ORACLE_PARTS["ox_report"] = f"""
SELECT d.domain, d.dbt_model, d.owner, coalesce(x.failure_type, 'unknown') AS failure_type, x.failure_timestamp, x.drop_fraction,
  CASE WHEN x.failure_timestamp IS NULL THEN 0 ELSE CAST(floor(epoch(TIMESTAMP '{AS_OF}' - x.failure_timestamp) / 86400) AS INT) END AS days_since_failure,
  coalesce(x.failure_type, '') IN ('hard_failure', 'schema_drift') AS requires_approval, x.dbt_model IS NOT NULL AS has_runs
FROM {{fx_domains}} d LEFT JOIN {{ox_detected}} x USING (dbt_model)
"""


def recent_runs(t: Tables) -> DataFrame:
    return P.in_lookback(t["fx_runs"], AS_OF)


def mapping(t: Tables) -> DataFrame:
    return t.domains.select("domain", "dbt_model", "owner")


def reports(t: Tables) -> DataFrame:
    return P.root_cause_report(mapping(t), t["fx_runs"], AS_OF)


@query("hard_failure", "SELECT * FROM {ox_failed}")
def _(t: Tables) -> DataFrame:
    return P.hard_failure(recent_runs(t))


@query("silent_drop", "SELECT * FROM {ox_dropped}")
def _(t: Tables) -> DataFrame:
    return P.silent_drop(recent_runs(t))


@query("schema_drift", "SELECT * FROM {ox_drifted}")
def _(t: Tables) -> DataFrame:
    return P.schema_drift(recent_runs(t))


@query("run_gap", "SELECT * FROM {ox_gap}")
def _(t: Tables) -> DataFrame:
    return P.run_gap(recent_runs(t))


@query("detect_failure", "SELECT * FROM {ox_detected}")
def _(t: Tables) -> DataFrame:
    return P.detect_failure(t["fx_runs"], AS_OF)


@query(
    "root_cause_report",
    "SELECT domain, dbt_model, owner, failure_type, failure_timestamp, drop_fraction, days_since_failure, requires_approval FROM {ox_report}",
)
def _(t: Tables) -> DataFrame:
    return reports(t).drop("downstream", "options")


@query(
    "downstream_domains",
    """SELECT r.domain, CASE WHEN has_runs THEN (SELECT string_agg(o.domain, ',' ORDER BY o.domain) FROM {fx_domains} o WHERE o.domain <> r.domain)
      ELSE '' END AS downstream FROM {ox_report} r""",
)
def _(t: Tables) -> DataFrame:
    return reports(t).select("domain", F.array_join("downstream", ",").alias("downstream"))


@query(
    "remediation_options",
    """SELECT domain, failure_type, pos, action, estimated_minutes, risk_level, auto_executable FROM {ox_report} JOIN (VALUES
      ('silent_drop', 1, 'refresh', 8, 'Low', true), ('silent_drop', 2, 'full_refresh', 45, 'Medium', false), ('silent_drop', 3, 'alert_only', 1, 'Low', true),
      ('schema_drift', 1, 'schema_patch', 30, 'High', false), ('schema_drift', 2, 'alert_only', 1, 'Low', true),
      ('gap', 1, 'refresh', 15, 'Low', true), ('gap', 2, 'alert_only', 1, 'Low', true),
      ('hard_failure', 1, 'full_refresh', 60, 'High', false), ('hard_failure', 2, 'alert_only', 1, 'Low', true), ('unknown', 1, 'alert_only', 1, 'Low', true)
    ) AS o(failure_type, pos, action, estimated_minutes, risk_level, auto_executable) USING (failure_type)""",
)
def _(t: Tables) -> DataFrame:
    return reports(t).select("domain", "failure_type", F.inline("options")).drop("description")


@query(
    "failure_event",
    """SELECT domain, failure_type, days_since_failure AS days_since, CASE WHEN days_since_failure < 30 THEN 'WARNING' ELSE 'CRITICAL' END AS severity
    FROM {ox_report} WHERE failure_type <> 'unknown'""",
)
def _(t: Tables) -> DataFrame:
    events = P.failure_event(reports(t), AS_OF)
    payload = F.from_json("payload", "failure_type string, days_since int")
    return events.withColumn("_p", payload).select("domain", "_p.failure_type", "_p.days_since", "severity")


@query(
    "run_health",
    """SELECT count(*) AS total_domains, count(*) FILTER (failure_type <> 'unknown') AS failures_found,
      count(*) FILTER (failure_type <> 'unknown' AND requires_approval) AS pending_remediations FROM {ox_report}""",
)
def _(t: Tables) -> DataFrame:
    return P.run_health(reports(t))


_GATE = """SELECT o_orderkey AS request_id, domain, action, risk_level, CASE WHEN waits THEN 'pending_approval' ELSE 'executed' END AS status,
    CASE WHEN waits THEN NULL WHEN approver = '' THEN 'auto' ELSE approver END AS approved_by, waits
  FROM (SELECT *, risk_level = 'High' AND approver = '' AS waits FROM (SELECT o_orderkey, d.domain,
      CASE o_orderkey % 4 WHEN 0 THEN 'refresh' WHEN 1 THEN 'full_refresh' WHEN 2 THEN 'schema_patch' ELSE 'alert_only' END AS action,
      CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Low' END AS risk_level,
      CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE '' END AS approver
    FROM {orders} JOIN {fx_domains} d ON d.domain_id = o_custkey % 7))"""
ORACLE_PARTS["ox_gate"] = _GATE


def gated(t: Tables) -> DataFrame:
    key = F.col("o_orderkey") % 4
    actions = F.array(*[F.lit(a) for a in ("refresh", "full_refresh", "schema_patch", "alert_only")])
    risks = F.array(*[F.lit(a) for a in ("Low", "Medium", "High", "Low")])
    requests = t["orders"].join(t.domains, F.col("domain_id") == F.col("o_custkey") % 7).select(
        F.col("o_orderkey").alias("request_id"), "domain",
        F.get(actions, key.cast("int")).alias("action"), F.get(risks, key.cast("int")).alias("risk_level"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("approved_by"),
    )
    return P.remediation_gate(requests)


@query("remediation_gate", "SELECT * EXCLUDE (waits) FROM {ox_gate}")
def _(t: Tables) -> DataFrame:
    return gated(t)


@query(
    "remediation_outputs",
    f"""SELECT 'event' AS kind, 'REM-' || CAST(request_id AS STRING) AS id, domain, 'APPROVAL_REQUIRED' AS detail FROM {{ox_gate}} WHERE waits
    UNION ALL SELECT 'run', 'SIM-' || CAST(request_id AS STRING), domain, '{C.REMEDIATED_RUN["schema_version"]}' FROM {{ox_gate}} WHERE NOT waits""",
)
def _(t: Tables) -> DataFrame:
    events, runs = P.remediation_outputs(gated(t), mapping(t), AS_OF)
    return events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "domain", F.col("event_type").alias("detail")).unionByName(
        runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), "domain", F.col("schema_version").alias("detail"))
    )


@query(
    "run_log_union",
    """SELECT dbt_model, run_id, run_timestamp, status, rows_affected, schema_version FROM {fx_runs}
    UNION SELECT dbt_model, 'live-' || run_id, run_timestamp, status, NULL, 'dbt-live' FROM {fx_runs}""",
)
def _(t: Tables) -> DataFrame:
    runs = t["fx_runs"]
    live = runs.select(
        "dbt_model", F.concat(F.lit("live-"), "run_id").alias("run_id"), "run_timestamp", "status", F.lit("dbt-live").alias("schema_version")
    )
    return P.run_log_union(live.unionByName(live), runs)
