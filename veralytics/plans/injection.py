"""Queries over context injection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import injection as I
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables

# Staleness events about gold facts: each probe of a fact doubles as one.
ORACLE_PARTS["ox_ready"] = """
SELECT p.domain, p.entity, g.value, 'v' || CAST(g.version AS STRING) AS version, p.ready_at, p.ready_at + INTERVAL 4 HOUR AS expires
FROM (SELECT domain, entity, max(probe_ts) AS ready_at FROM {fx_probes} GROUP BY 1, 2) p
JOIN (SELECT *, row_number() OVER (PARTITION BY domain, entity ORDER BY version DESC, value DESC) AS rn FROM {ox_current}) g
  ON g.domain = p.domain AND g.entity = p.entity AND g.rn = 1
"""
# Pending context keyed by injection, and the click events as queries.
ORACLE_PARTS["ox_clicks"] = """
SELECT event_id AS query_id, ts AS query_ts, domain, props AS query
FROM {events} JOIN {fx_domains} ON domain_id = user_id % 7 WHERE event_type = 'click'
"""
ORACLE_PARTS["ox_injected"] = """
SELECT query_id, domain, query_ts, query, rn IS NOT NULL AS injected, injection_id AS entity, injected_value, expires_at FROM (
  SELECT q.*, p.injection_id, p.injected_value, p.expires_at, CASE WHEN p.injection_id IS NOT NULL THEN 1 END AS rn,
    row_number() OVER (PARTITION BY q.query_id ORDER BY p.injected_at, p.injection_id) AS pick
  FROM {ox_clicks} q LEFT JOIN {fx_injections} p ON p.domain = q.domain AND p.injected_at <= q.query_ts AND p.expires_at > q.query_ts) WHERE pick = 1
"""


def stale_events(t: Tables) -> DataFrame:
    return t["fx_probes"].select(
        F.col("probe_id").cast("string").alias("event_id"), F.col("probe_ts").alias("event_ts"),
        F.lit("STALENESS_DETECTED").alias("event_type"), "domain", "entity", F.lit("{}").alias("payload"),
    )


def ready(t: Tables) -> DataFrame:
    return I.injection_readiness(stale_events(t), t.gold)


def pending_log(t: Tables) -> DataFrame:
    return t["fx_injections"].select(
        "domain", F.col("injection_id").alias("entity"), F.col("injected_value").alias("value"), F.lit("v1").alias("version"),
        F.col("injected_at").alias("ready_at"), F.col("expires_at").alias("expires"),
    )


def clicks(t: Tables) -> DataFrame:
    asked = t["events"].filter(F.col("event_type") == "click").join(t.domains, F.col("domain_id") == F.col("user_id") % 7)
    return asked.select(F.col("event_id").alias("query_id"), F.col("ts").alias("query_ts"), "domain", F.col("props").alias("query"))


def injected(t: Tables) -> DataFrame:
    return I.inject(clicks(t), pending_log(t))


@query("injection_readiness", "SELECT * FROM {ox_ready}")
def _(t: Tables) -> DataFrame:
    return ready(t)


CLOCK = "2024-01-03 06:00:00"


@query(
    "active_pending",
    f"""SELECT domain, entity, value, version, CAST(floor(epoch(expires - TIMESTAMP '{CLOCK}') / 60) AS BIGINT) AS expires_in_min
    FROM {{ox_ready}} WHERE expires > TIMESTAMP '{CLOCK}'""",
)
def _(t: Tables) -> DataFrame:
    return I.active_pending(ready(t), CLOCK).drop("ready_at")


@query("inject", "SELECT query_id, domain, query_ts, injected, entity, injected_value, expires_at FROM {ox_injected}")
def _(t: Tables) -> DataFrame:
    return injected(t).drop("query", "source_version")


@query(
    "context_block",
    """SELECT query_id, CASE WHEN injected THEN '[VERIFIED CONTEXT — ' || strftime(query_ts, '%Y-%m-%d %H:%M') || ' UTC]' || chr(10)
        || 'Source: Gold layer v1 (enterprise data warehouse)' || chr(10) || 'Entity: ' || entity || ' (domain: ' || domain || ')' || chr(10)
        || 'Current value: ' || injected_value || chr(10) || 'Note: This value supersedes any prior model knowledge. Valid until '
        || strftime(expires_at, '%H:%M') || ' UTC.' || chr(10) || chr(10) || chr(10) || query ELSE query END AS prompt FROM {ox_injected}""",
)
def _(t: Tables) -> DataFrame:
    return I.context_block(injected(t)).select("query_id", "prompt")


ORACLE_PARTS["ox_injection_log"] = """
SELECT CAST(query_id AS STRING) AS injection_id, query_ts AS injected_at, domain, entity, injected_value, substring(query, 1, 120) AS query_preview,
  expires_at, 'agent_call' AS triggered_by FROM {ox_injected} WHERE injected
"""


@query(
    "injection_history",
    f"SELECT * FROM {{ox_injection_log}} WHERE injected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND domain = 'coupons'",
)
def _(t: Tables) -> DataFrame:
    return I.injection_history(I.injection_log(injected(t)), AS_OF, 72, "coupons").drop("source_version")


@query(
    "injection_stats",
    f"""SELECT domain, coalesce(a.n, 0) AS injections_24h, coalesce(p.active, 0) AS active_injections, coalesce(p.n, 0) AS pending_entities
    FROM (SELECT domain, count(*) AS n FROM {{ox_injection_log}} WHERE injected_at >= TIMESTAMP '{CLOCK}' - INTERVAL 24 HOUR GROUP BY 1) a
    FULL JOIN (SELECT domain, count(*) AS n, count(*) FILTER (expires > TIMESTAMP '{CLOCK}') AS active FROM {{ox_ready}} GROUP BY 1) p USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    return I.injection_stats(I.injection_log(injected(t)), ready(t), CLOCK)
