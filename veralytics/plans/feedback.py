"""Queries over correction signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import feedback as B
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables

_DEC = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ORACLE_PARTS["ox_classed"] = rf"""
SELECT * EXCLUDE (wn, cn, wt, ct), CASE WHEN cn <> 0 AND abs(wn - cn) / abs(cn) >= CAST(0.2 AS DOUBLE) THEN 'THRESHOLD_ERROR'
    WHEN len(wt) = 0 OR len(ct) = 0 THEN 'CLASSIFICATION_ERROR'
    WHEN CAST(len(list_intersect(wt, ct)) AS DOUBLE) / (len(wt) + len(ct) - len(list_intersect(wt, ct))) < CAST(0.3 AS DOUBLE) THEN 'DEFINITION_ERROR'
    ELSE 'RETRIEVAL_ERROR' END AS error_type
FROM (SELECT *, CASE WHEN regexp_matches(wrong_value, '{_DEC}') THEN TRY_CAST(trim(wrong_value) AS DOUBLE) END AS wn,
  CASE WHEN regexp_matches(correct_value, '{_DEC}') THEN TRY_CAST(trim(correct_value) AS DOUBLE) END AS cn,
  list_distinct(regexp_extract_all(lower(wrong_value), '\S+')) AS wt, list_distinct(regexp_extract_all(lower(correct_value), '\S+')) AS ct FROM {{fx_feedback}})
"""
ORACLE_PARTS["ox_routed"] = """
SELECT c.*, CASE error_type WHEN 'THRESHOLD_ERROR' THEN 'flag_gold_and_reprobe' WHEN 'DEFINITION_ERROR' THEN 'flag_domain_definition'
    WHEN 'RETRIEVAL_ERROR' THEN 'reweight_chroma' ELSE 'update_gold_and_reprobe' END AS routing_action,
  error_type = 'RETRIEVAL_ERROR' AS auto_executable, error_type <> 'RETRIEVAL_ERROR' AS requires_approval,
  CASE WHEN error_type = 'RETRIEVAL_ERROR' THEN CAST(1.5 AS DOUBLE) END AS boost,
  error_type = 'DEFINITION_ERROR' AND count(*) OVER (PARTITION BY domain, entity) >= 10 AS fine_tune
FROM {ox_classed} c
"""
# Approvals: every signal of three of the seven domains.
ORACLE_PARTS["ox_applied"] = """
SELECT r.*, CASE WHEN d.risk_category = 'High' THEN 'lead' ELSE '' END AS approved_by, NOT requires_approval OR d.risk_category = 'High' AS applied
FROM {ox_routed} r JOIN {fx_domains} d USING (domain)
"""


def routed(t: Tables) -> DataFrame:
    return B.route_correction(t["fx_feedback"])


def applied(t: Tables) -> DataFrame:
    high = t.domains.filter(F.col("risk_category") == "High").select("domain")
    approvals = t["fx_feedback"].join(high, "domain", "left_semi").select("signal_id", F.lit("lead").alias("approved_by"))
    return B.apply_routing(routed(t), approvals)


@query(
    "capture_signal",
    """SELECT signal_id, CASE WHEN signal_type IN ('user_correction', 'agent_override', 'escalation', 'non_use') THEN signal_type ELSE 'user_correction' END AS signal_type,
      CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN 'classified' ELSE 'pending' END AS fle_status FROM {fx_feedback}""",
)
def _(t: Tables) -> DataFrame:
    return B.capture_signal(t["fx_feedback"]).select("signal_id", "signal_type", "fle_status")


@query(
    "signal_events",
    "SELECT 'EVT-' || signal_id AS event_id, signal_ts AS event_ts, domain, entity, correct_value FROM {fx_feedback} WHERE confidence >= CAST(0.7 AS DOUBLE)",
)
def _(t: Tables) -> DataFrame:
    events = B.signal_events(B.capture_signal(t["fx_feedback"]))
    return events.select("event_id", "event_ts", "domain", "entity", F.get_json_object("payload", "$.correct_value").alias("correct_value"))


@query("classify_error", "SELECT signal_id, error_type FROM {ox_classed}")
def _(t: Tables) -> DataFrame:
    return t["fx_feedback"].select("signal_id", B.classify_error(F.col("wrong_value"), F.col("correct_value")).alias("error_type"))


_ROUTED = ["signal_id", "error_type", "routing_action", "auto_executable", "requires_approval", "boost", "fine_tune"]


@query("route_correction", f"SELECT {', '.join(_ROUTED)} FROM {{ox_routed}}")
def _(t: Tables) -> DataFrame:
    return routed(t).select(*_ROUTED)


@query("repeat_error_count", "SELECT domain, entity, count(*) AS repeats FROM {fx_feedback} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return B.repeat_error_count(t["fx_feedback"])


@query(
    "finetune_pairs",
    """SELECT signal_id, 'What is the current value for ' || entity || '?' AS instruction,
      'The current value for ' || entity || ' is ' || correct_value || '. Note: ' || wrong_value || ' is outdated.' AS response FROM {ox_routed} WHERE fine_tune""",
)
def _(t: Tables) -> DataFrame:
    return B.finetune_pairs(routed(t))


@query(
    "apply_routing",
    """SELECT signal_id, applied, approved_by, CASE WHEN applied THEN 'applied' ELSE fle_status END AS fle_status, CASE WHEN NOT applied THEN ''
      WHEN error_type IN ('THRESHOLD_ERROR', 'CLASSIFICATION_ERROR') THEN 'Gold layer flagged: ' || entity || ' → ' || correct_value
      WHEN error_type = 'RETRIEVAL_ERROR' THEN 'Retrieval boosted: ' || entity || ' (boost=1.5)'
      WHEN fine_tune THEN 'Fine-tune pair written' ELSE '' END AS actions FROM {ox_applied}""",
)
def _(t: Tables) -> DataFrame:
    return applied(t).select("signal_id", "applied", "approved_by", "fle_status", F.array_join("actions", "; ").alias("actions"))


@query(
    "routing_events",
    """SELECT 'CORRECTION_APPLIED-' || signal_id AS event_id, 'CORRECTION_APPLIED' AS event_type, domain, entity FROM {ox_applied} WHERE applied
    UNION ALL SELECT 'REPROBE_REQUESTED-' || signal_id, 'REPROBE_REQUESTED', domain, entity FROM {ox_applied}
    WHERE applied AND error_type IN ('THRESHOLD_ERROR', 'CLASSIFICATION_ERROR')""",
)
def _(t: Tables) -> DataFrame:
    return B.routing_events(applied(t), AS_OF).select("event_id", "event_type", "domain", "entity")


# Corrections name users, gold facts name parts: facts here are keyed like the signals.
ORACLE_PARTS["ox_facts"] = "SELECT domain, 'e' || CAST(user_id AS STRING) AS entity, n AS fact_id FROM {fx_bus}"


@query(
    "flag_gold",
    """SELECT f.domain, f.entity, fact_id, c.correct_value IS NOT NULL AS fle_flagged, c.correct_value AS fle_correct_value FROM {ox_facts} f
    LEFT JOIN (SELECT domain, entity, correct_value, row_number() OVER (PARTITION BY domain, entity ORDER BY signal_ts DESC, signal_id DESC) AS rn
      FROM {ox_applied} WHERE applied AND error_type IN ('THRESHOLD_ERROR', 'CLASSIFICATION_ERROR')) c ON c.domain = f.domain AND c.entity = f.entity AND c.rn = 1""",
)
def _(t: Tables) -> DataFrame:
    facts = t["fx_bus"].select("domain", F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entity"), F.col("n").alias("fact_id"))
    return B.flag_gold(facts, applied(t))


_SUM = "count(*) AS signals, count(*) FILTER (fle_status = 'applied') AS applied, count(*) FILTER (fle_status = 'pending') AS pending, round(CAST(count(*) FILTER (fle_status = 'applied') AS DOUBLE) / count(*), 3) AS closure_rate"


@query(
    "feedback_summary",
    f"""SELECT 'total' AS dimension, 'all' AS key, {_SUM} FROM {{fx_feedback}} UNION ALL SELECT 'type', signal_type, {_SUM} FROM {{fx_feedback}} GROUP BY signal_type
    UNION ALL SELECT 'domain', domain, {_SUM} FROM {{fx_feedback}} GROUP BY domain""",
)
def _(t: Tables) -> DataFrame:
    return B.feedback_summary(t["fx_feedback"])


@query(
    "learning_velocity",
    f"""SELECT signals, applied, round(CAST(applied AS DOUBLE) / signals, 3) AS learning_velocity, round(1 - CAST(biggest AS DOUBLE) / signals, 3) AS repeat_error_reduction_rate,
      round(CAST(applied AS DOUBLE) / signals, 3) < 0.3 AS alert
    FROM (SELECT CAST(sum(n) AS BIGINT) AS signals, CAST(sum(a) AS BIGINT) AS applied, max(n) AS biggest FROM (
      SELECT domain, entity, count(*) AS n, count(*) FILTER (fle_status = 'applied') AS a FROM {{fx_feedback}}
      WHERE signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1, 2))""",
)
def _(t: Tables) -> DataFrame:
    return B.learning_velocity(t["fx_feedback"], AS_OF, days=14)


@query(
    "corrections_per_week",
    f"""SELECT CAST(w AS INT) AS week, coalesce(n, 0) AS signals FROM range(4) r(w) LEFT JOIN (
      SELECT CAST(floor(epoch(signal_ts - (TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)) / 604800) AS BIGINT) AS w, count(*) AS n FROM {{fx_feedback}}
      WHERE signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1) USING (w)""",
)
def _(t: Tables) -> DataFrame:
    return B.corrections_per_week(t["fx_feedback"], AS_OF)


@query(
    "weekly_improvement",
    f"""WITH f AS (SELECT *, signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS now FROM {{fx_feedback}}
      WHERE signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND signal_ts < TIMESTAMP '{AS_OF}')
    SELECT t AS corrections_this_week, l AS corrections_last_week, t - l AS delta, rate AS repeat_error_rate, '2024-W05' AS week_ending
    FROM (SELECT count(*) FILTER (now AND fle_status = 'applied') AS t, count(*) FILTER (NOT now AND fle_status = 'applied') AS l FROM f),
      (SELECT round(CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*), 3) AS rate FROM (SELECT count(*) AS n FROM f WHERE now GROUP BY domain, entity))""",
)
def _(t: Tables) -> DataFrame:
    return B.weekly_improvement(t["fx_feedback"], AS_OF)


@query(
    "improvement_event",
    f"""WITH f AS (SELECT *, signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS now FROM {{fx_feedback}}
      WHERE signal_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND signal_ts < TIMESTAMP '{AS_OF}')
    SELECT 'IMP-2024-W05' AS event_id, TIMESTAMP '{AS_OF}' AS event_ts, 'FLE' AS source_module, 'LEARNING_IMPROVEMENT' AS event_type, 'all' AS domain,
      'INFO' AS severity, false AS requires_approval, t AS this_week, t - l AS delta, '2024-W05' AS week_ending
    FROM (SELECT count(*) FILTER (now AND fle_status = 'applied') AS t, count(*) FILTER (NOT now AND fle_status = 'applied') AS l FROM f)""",
)
def _(t: Tables) -> DataFrame:
    body = F.from_json("payload", "corrections_this_week bigint, delta bigint, week_ending string")
    events = B.improvement_event(B.weekly_improvement(t["fx_feedback"], AS_OF), AS_OF).withColumn("_p", body)
    return events.select(
        "event_id", "event_ts", "source_module", "event_type", "domain", "severity", "requires_approval",
        F.col("_p.corrections_this_week").alias("this_week"), "_p.delta", "_p.week_ending",
    )
