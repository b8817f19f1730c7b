"""Streaming queries run to the end of the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import dims
from veralytics.plans.injection import stale_events
from veralytics.plans.registry import query
from veralytics.sources.fixtures import ORACLE_PARTS, Tables
from veralytics.sources.sinks import scratch
from veralytics.streaming import streams as Z


def streaming(t: Tables) -> Tables:
    """The same tables, with the event table read as a stream."""
    live = Tables(t.spark, t.sf_dir)
    live._made["events"] = Z.table_stream(t.spark, t.sf_dir, "events", t["events"].schema)
    return live


@query("readiness_stream", "SELECT p.domain, p.entity, r.value, r.version, p.probe_ts AS ready_at FROM {fx_probes} p JOIN {ox_ready} r USING (domain, entity)")
def _(t: Tables) -> DataFrame:
    ready = Z.readiness_stream(stale_events(streaming(t)), t.gold)
    return Z.run_available(ready, scratch(t.spark)).drop("batch", "expires")


# The whole log is one batch; the watermark then stands one hour behind the newest row.
ORACLE_PARTS["ox_final"] = """
SELECT *, CASE WHEN ready_at + INTERVAL 4 HOUR <= max(ready_at) OVER () - INTERVAL 1 HOUR THEN 'expired' ELSE 'active' END AS status FROM {ox_ready}
"""


@query("pending_stream", "SELECT domain, entity, value, version, ready_at, status FROM {ox_final}")
def _(t: Tables) -> DataFrame:
    ready = Z.readiness_stream(stale_events(streaming(t)), t.gold)
    rows = Z.run_available(Z.pending_stream(ready), scratch(t.spark), "update")
    last = F.max_by(F.struct("value", "version", "ready_at", "status"), "batch")
    return rows.groupBy("domain", "entity").agg(last.alias("_r")).select("domain", "entity", "_r.*")


@query("pending_table", "SELECT domain, entity, value, version, ready_at, expires FROM {ox_final} WHERE status = 'active'")
def _(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    ready = Z.readiness_stream(stale_events(streaming(t)), t.gold)
    with Z.rocks_state(t.spark):
        Z.run_available(Z.pending_state(ready), folder, "update")
    return Z.pending_table(t.spark, f"{folder}/_checkpoint")


@query("link_stream", "SELECT outcome_id, outcome_ts, domain FROM {ox_linked}")
def _(t: Tables) -> DataFrame:
    # Two readers of the same files: a stream joined with itself needs its own source on each side.
    one, two = streaming(t), streaming(t)
    linked = Z.link_stream(one["fx_injections"], two["fx_outcomes"])
    return Z.run_available(linked, scratch(t.spark)).select("outcome_id", "outcome_ts", "domain")


@query(
    "digest_stream",
    """SELECT window_start, ind AS industry, count(*) AS events, count(*) FILTER (severity = 'CRITICAL') AS criticals,
      count(*) FILTER (event_type = 'EXPIRY_ALERT') AS expiries FROM {ox_notified} GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    live = streaming(t)
    counts = Z.run_available(Z.digest_stream(live.bus, dims.industries(t.spark)), scratch(t.spark), "update")
    newest = counts.groupBy("window_start", "industry").agg(F.max_by(F.struct("events", "criticals", "expiries"), "batch").alias("_c"))
    return newest.select("window_start", "industry", "_c.*")


@query(
    "route_events",
    """SELECT 'injection' AS subscriber, count(*) AS events FROM {fx_bus} WHERE event_type = 'STALENESS_DETECTED'
    UNION ALL SELECT 'root_cause', count(*) FROM {fx_bus} WHERE event_type = 'STALENESS_DETECTED'
    UNION ALL SELECT 'value', count(*) FROM {fx_bus} WHERE event_type IN ('CONTEXT_INJECTED', 'PIPELINE_FAILURE_FOUND', 'CORRECTION_APPLIED')
    UNION ALL SELECT 'feedback', count(*) FROM {fx_bus} WHERE event_type IN ('CONTEXT_INJECTED', 'CORRECTION_RECEIVED')
    UNION ALL SELECT 'governance', count(*) FROM {fx_bus} WHERE event_type = 'VALUE_CALCULATED'
    UNION ALL SELECT 'reprobe', count(*) FROM {fx_bus} WHERE event_type = 'REPROBE_REQUESTED'
    UNION ALL SELECT 'notification', count(*) FROM {fx_bus} WHERE event_type IN ('EXPIRY_ALERT', 'STALENESS_DETECTED', 'PIPELINE_FAILURE_FOUND', 'DATA_CONTRACT_EXPIRY')
    UNION ALL SELECT 'approvals', count(*) FROM {fx_bus} WHERE event_type = 'APPROVAL_REQUIRED' OR requires_approval OR severity = 'CRITICAL'""",
)
def _(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    Z.route_events(streaming(t).bus, folder).awaitTermination()
    out = None
    for name in (*Z.SUBSCRIBERS, "approvals"):
        one = t.spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("events")).select(F.lit(name).alias("subscriber"), "events")
        out = one if out is None else out.unionByName(one)
    return out
