"""Queries over the event log and approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import dims
from veralytics.operators import events as E
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables

_LOG = "event_id, event_ts, source_module, event_type, domain, entity, severity"
_COLUMNS = _LOG.split(", ")
_DAY = f"event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"
# A clock inside the data, so that day windows hold events.
MID = "2024-01-16 12:00:00"
_MID_DAY = f"event_ts >= TIMESTAMP '{MID}' - INTERVAL 24 HOUR"

ORACLE_PARTS["ox_queue"] = """
SELECT 'REQ-' || event_id AS request_id, event_ts AS requested_at, source_module, event_type, domain, entity,
  CASE WHEN event_type = 'APPROVAL_REQUIRED' AND user_id % 3 = 0 THEN 'full_refresh'
    WHEN event_type = 'APPROVAL_REQUIRED' AND user_id % 3 = 1 THEN 'reweight_chroma' ELSE 'review' END AS proposed_action,
  CASE WHEN event_type = 'APPROVAL_REQUIRED' AND user_id % 3 = 0 THEN 'High' ELSE 'Medium' END AS risk_level,
  substring(payload, 1, 200) AS payload_summary, n
FROM {fx_bus} WHERE event_type = 'APPROVAL_REQUIRED' OR requires_approval OR severity = 'CRITICAL'
"""
# Decisions on the requests: by the request's own number, some decided twice.
ORACLE_PARTS["ox_decisions"] = """
SELECT request_id, CASE n % 4 WHEN 0 THEN 'approved' ELSE 'rejected' END AS decision, 'lead' || CAST(n % 3 AS STRING) AS lead,
  requested_at + INTERVAL 1 HOUR AS decided_at FROM {ox_queue} WHERE source_module <> 'FLE'
UNION ALL
SELECT request_id, 'approved', 'chief', requested_at + INTERVAL 2 HOUR FROM {ox_queue} WHERE source_module = 'PP'
"""
ORACLE_PARTS["ox_decided"] = """
SELECT q.*, coalesce(d.decision, 'pending') AS status, coalesce(d.lead, '') AS decided_by, d.decided_at
FROM {ox_queue} q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY decided_at DESC, decision DESC) AS rn FROM {ox_decisions}) d
  ON d.request_id = q.request_id AND d.rn = 1
"""


def queue(t: Tables) -> DataFrame:
    return E.queue_for_approval(t.bus)


def decisions(t: Tables) -> DataFrame:
    asked = queue(t).withColumn("n", F.substring("request_id", 5, 20).cast("bigint"))
    first = asked.filter(F.col("source_module") != "FLE").select(
        "request_id",
        F.when(F.col("n") % 4 == 0, "approved").otherwise("rejected").alias("decision"),
        F.concat(F.lit("lead"), (F.col("n") % 3).cast("string")).alias("lead"),
        (F.col("requested_at") + F.expr("INTERVAL 1 HOUR")).alias("decided_at"),
    )
    second = asked.filter(F.col("source_module") == "PP").select(
        "request_id", F.lit("approved").alias("decision"), F.lit("chief").alias("lead"),
        (F.col("requested_at") + F.expr("INTERVAL 2 HOUR")).alias("decided_at"),
    )
    return first.unionByName(second)


def decided(t: Tables) -> DataFrame:
    return E.decide_approvals(queue(t), decisions(t))


@query(
    "critical_escalation",
    f"SELECT {_LOG}, requires_approval OR severity = 'CRITICAL' AS requires_approval FROM {{fx_bus}}",
)
def _(t: Tables) -> DataFrame:
    return E.critical_escalation(t.bus).drop("payload")


@query(
    "get_chain",
    f"SELECT {_LOG} FROM {{fx_bus}} WHERE domain = 'coupons' AND entity = 'e6' AND event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR",
)
def _(t: Tables) -> DataFrame:
    return E.get_chain(t.bus, AS_OF, "coupons", "e6", hours=720).select(*_COLUMNS)


@query(
    "replay",
    f"SELECT {_LOG} FROM {{fx_bus}} WHERE event_ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00'",
)
def _(t: Tables) -> DataFrame:
    return E.replay(t.bus, "2024-01-10 00:00:00", "2024-01-12 06:00:00").select(*_COLUMNS)


@query("recent", f"SELECT {_LOG} FROM {{fx_bus}} WHERE {_DAY} AND source_module = 'PP' AND event_type = 'APPROVAL_REQUIRED'")
def _(t: Tables) -> DataFrame:
    return E.recent(t.bus, AS_OF, 24, "PP", "APPROVAL_REQUIRED").select(*_COLUMNS)


@query(
    "event_stats",
    """SELECT 'total' AS dimension, 'all' AS key, count(*) AS events FROM {fx_bus}
    UNION ALL SELECT 'type', event_type, count(*) FROM {fx_bus} GROUP BY event_type
    UNION ALL SELECT 'module', source_module, count(*) FROM {fx_bus} GROUP BY source_module""",
)
def _(t: Tables) -> DataFrame:
    return E.event_stats(t.bus)


@query(
    "causal_chain",
    f"""SELECT domain, entity, count(*) AS events, min(event_ts) AS first_event, max(event_ts) AS last_event,
      CAST(coalesce(sum(cents) FILTER (event_type = 'VALUE_CALCULATED'), 0) AS DOUBLE) AS total_exposure_usd,
      CAST(coalesce(sum(tenths) FILTER (event_type = 'CORRECTION_APPLIED'), 0) AS DOUBLE) AS total_recovered_usd,
      (SELECT count(*) FROM {{ox_decided}} WHERE status = 'pending') AS open_approvals
    FROM {{fx_bus}} WHERE {_MID_DAY} GROUP BY domain, entity""",
)
def _(t: Tables) -> DataFrame:
    return E.causal_chain(t.bus, decided(t), MID)


@query(
    "chain_narrative",
    f"""SELECT domain, entity, event_ts, event_id, '  ' || strftime(event_ts, '%H:%M') || ' UTC — ' || CASE event_type
        WHEN 'STALENESS_DETECTED' THEN '🔴 DKSM detected staleness (level: ' || CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'STALE' END || ')'
        WHEN 'CONTEXT_INJECTED' THEN '💉 LCI injected verified context → value: ' || CAST(units AS STRING)
        WHEN 'PIPELINE_FAILURE_FOUND' THEN '⚙️ PP found pipeline root cause (gap, ' || CAST(units AS STRING) || 'd ago)'
        WHEN 'VALUE_CALCULATED' THEN '💰 AVL calculated financial exposure → exposure: $' || format('{{{{:,}}}}', cents)
        WHEN 'CORRECTION_RECEIVED' THEN '📥 FLE received correction signal'
        WHEN 'CORRECTION_APPLIED' THEN '✅ FLE applied correction' WHEN 'APPROVAL_REQUIRED' THEN '⏳ ASGC approval requested'
        ELSE event_type END AS line
    FROM {{fx_bus}} WHERE {_MID_DAY}""",
)
def _(t: Tables) -> DataFrame:
    return E.chain_narrative(t.bus, MID)


_HEALTH = f"""
WITH r AS (SELECT * FROM {{fx_bus}} WHERE {_MID_DAY}),
p AS (SELECT count(*) AS pending, count(*) FILTER (source_module = 'PP') AS pp FROM {{ox_decided}} WHERE status = 'pending'),
c AS (SELECT CASE WHEN count(*) FILTER (event_type = 'STALENESS_DETECTED' AND severity = 'CRITICAL') > 0 THEN 'CRITICAL' ELSE 'OK' END AS s1,
  CASE WHEN count(*) FILTER (event_type = 'PIPELINE_FAILURE_FOUND' AND source_module = 'PP') > 0 THEN 'WARNING' ELSE 'OK' END AS s2 FROM r)
SELECT 'DKSM' AS module, s1 AS status, 'critical_count' AS metric, (SELECT count(*) FROM r WHERE event_type = 'STALENESS_DETECTED' AND source_module = 'DKSM') AS value FROM c
UNION ALL SELECT 'LCI', 'OK', 'active_injections', (SELECT count(*) FROM r WHERE event_type = 'CONTEXT_INJECTED' AND source_module = 'LCI')
UNION ALL SELECT 'LCI', 'OK', 'injection_rate_24h', (SELECT count(*) FROM r WHERE source_module = 'LCI')
UNION ALL SELECT 'PP', s2, 'failures_found', (SELECT count(*) FROM r WHERE event_type = 'PIPELINE_FAILURE_FOUND' AND source_module = 'PP') FROM c
UNION ALL SELECT 'PP', s2, 'pending_remediations', (SELECT pp FROM p) FROM c
UNION ALL SELECT 'AVL', 'OK', 'value_events_24h', (SELECT count(*) FROM r WHERE event_type = 'VALUE_CALCULATED' AND source_module = 'AVL')
UNION ALL SELECT 'FLE', 'OK', 'signals_24h', (SELECT count(*) FROM r WHERE event_type = 'CORRECTION_RECEIVED' AND source_module = 'FLE')
UNION ALL SELECT 'FLE', 'OK', 'applied_24h', (SELECT count(*) FROM r WHERE event_type = 'CORRECTION_APPLIED' AND source_module = 'FLE')
UNION ALL SELECT 'ASGC', 'WARNING', 'pending_approvals', (SELECT pending FROM p)
UNION ALL SELECT 'ASGC', 'WARNING', 'lead_configured', 0
"""
ORACLE_PARTS["ox_stack"] = _HEALTH


@query("stack_health", "SELECT * FROM {ox_stack}")
def _(t: Tables) -> DataFrame:
    return E.stack_health(t.bus, decided(t), MID)


_INDUSTRY = """CASE WHEN event_type = 'EXPIRY_ALERT' AND user_id % 5 = 0 THEN 'Hospitality' ELSE industry END"""


@query(
    "event_timeline",
    f"""SELECT event_ts, event_id, source_module, event_type, domain, entity, {_INDUSTRY} AS industry,
      CASE event_type WHEN 'CORRECTION_RECEIVED' THEN 'yes' WHEN 'CORRECTION_APPLIED' THEN 'no' ELSE '—' END AS corrected, severity
    FROM {{fx_bus}} JOIN {{fx_domains}} USING (domain) WHERE {_DAY} ORDER BY event_ts DESC, event_id DESC LIMIT 60""",
)
def _(t: Tables) -> DataFrame:
    return E.event_timeline(t.bus, dims.industries(t.spark), AS_OF)


@query(
    "expiry_cards",
    f"""SELECT event_id, event_type, domain, entity, {_INDUSTRY} AS industry,
      CASE WHEN user_id % 5 = 0 THEN 999 ELSE n % 40 END AS days_left, CASE WHEN user_id % 5 = 0 THEN '?' ELSE '2024-02-03' END AS expiry_date,
      CASE WHEN user_id % 5 = 0 THEN 'REVIEW' ELSE 'REMOVE' END AS recommended_action
    FROM {{fx_bus}} JOIN {{fx_domains}} USING (domain) WHERE {_DAY} AND event_type = 'EXPIRY_ALERT' ORDER BY days_left, event_ts, event_id LIMIT 8""",
)
def _(t: Tables) -> DataFrame:
    return E.expiry_cards(t.bus, dims.industries(t.spark), AS_OF)


ORACLE_PARTS["ox_first_exposure"] = """
SELECT domain, exposure_usd FROM (SELECT domain, CAST(cents AS DOUBLE) AS exposure_usd,
  row_number() OVER (PARTITION BY domain ORDER BY event_ts, event_id) AS rn
  FROM {fx_bus} WHERE event_type = 'VALUE_CALCULATED' AND cents <> 0 AND event_ts >= TIMESTAMP '2024-01-31 21:00:00' - INTERVAL 720 HOUR) WHERE rn = 1
"""


@query("first_exposure_per_domain", "SELECT * FROM {ox_first_exposure}")
def _(t: Tables) -> DataFrame:
    return E.first_exposure_per_domain(t.bus, AS_OF)


@query(
    "value_kpis",
    """SELECT total AS total_exposure_usd, round(total * 0.65) AS recovered_usd, round(total * 0.65) - 5000 AS net_value_usd,
      round(round(total * 0.65) / 5000, 1) AS roi_multiple
    FROM (SELECT CAST(sum(exposure_usd) AS DOUBLE) AS total FROM {ox_first_exposure})""",
)
def _(t: Tables) -> DataFrame:
    return E.value_kpis(E.first_exposure_per_domain(t.bus, AS_OF))


@query(
    "queue_for_approval",
    """SELECT request_id, requested_at, source_module, event_type, domain, entity, proposed_action, risk_level, payload_summary,
      'pending' AS status FROM {ox_queue}""",
)
def _(t: Tables) -> DataFrame:
    return queue(t).drop("decided_by", "decided_at")


@query(
    "decide_approvals",
    "SELECT request_id, domain, proposed_action, status, decided_by, decided_at FROM {ox_decided}",
)
def _(t: Tables) -> DataFrame:
    return decided(t).select("request_id", "domain", "proposed_action", "status", "decided_by", "decided_at")


@query(
    "decision_events",
    """SELECT 'DEC-' || request_id AS event_id, decided_at AS event_ts, CASE status WHEN 'approved' THEN 'APPROVAL_GRANTED' ELSE 'APPROVAL_REJECTED' END AS event_type,
      domain, entity, decided_by FROM {ox_decided} WHERE status <> 'pending'""",
)
def _(t: Tables) -> DataFrame:
    who = F.coalesce(E.field("approved_by"), E.field("rejected_by"))
    return E.decision_events(decided(t)).select(
        "event_id", "event_ts", "event_type", "domain", "entity", who.alias("decided_by")
    )


@query("pending_approvals", "SELECT request_id, source_module, domain, risk_level FROM {ox_decided} WHERE status = 'pending'")
def _(t: Tables) -> DataFrame:
    return E.pending_approvals(decided(t)).select("request_id", "source_module", "domain", "risk_level")


@query(
    "pending_count",
    "SELECT source_module, risk_level, count(*) AS pending FROM {ox_decided} WHERE status = 'pending' GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    return E.pending_by_risk(decided(t))


@query(
    "board_tables",
    """SELECT 'health' AS section, module AS item, metric AS detail, status AS state, CAST(value AS STRING) AS figure FROM {ox_stack}
    UNION ALL SELECT * FROM (SELECT 'pending', request_id, substring(proposed_action, 1, 30), risk_level, strftime(requested_at, '%m-%d %H:%M')
      FROM {ox_decided} WHERE status = 'pending' ORDER BY requested_at, request_id LIMIT 10)""",
)
def _(t: Tables) -> DataFrame:
    waiting = decided(t)
    return E.board_tables(E.stack_health(t.bus, waiting, MID), waiting)


@query(
    "industry_of",
    f"SELECT event_id, domain, {_INDUSTRY} AS industry FROM {{fx_bus}} JOIN {{fx_domains}} USING (domain)",
)
def _(t: Tables) -> DataFrame:
    return E.industry_of(t.bus, dims.industries(t.spark)).select("event_id", "domain", "industry")
