"""Event log queries, causal chains and governance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock

Moment = datetime | str


def field(path: str) -> Column:
    """One payload field as text; null when absent."""
    return F.get_json_object("payload", f"$.{path}")


def critical_escalation(events: DataFrame) -> DataFrame:
    """A CRITICAL event always requires approval."""
    flag = F.coalesce(F.col("requires_approval"), F.lit(False))
    return events.withColumn("requires_approval", flag | (F.col("severity") == "CRITICAL"))


def between(events: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events from ``start`` to ``end``, both included.

    The log is stored by ``event_date``; where that column is there, whole days outside are
    not read.
    """
    days = "event_date" in events.columns
    if start is not None:
        events = events.filter(F.col("event_ts") >= start)
        events = events.filter(F.col("event_date") >= start.cast("date")) if days else events
    if end is not None:
        events = events.filter(F.col("event_ts") <= end)
        events = events.filter(F.col("event_date") <= end.cast("date")) if days else events
    return events


def _since(events: DataFrame, as_of: Moment, hours: int) -> DataFrame:
    return between(events, clock.moment(as_of) - clock.hours(hours))


def get_chain(events: DataFrame, as_of: Moment, domain: str, entity: str | None = None, hours: int = 24) -> DataFrame:
    """Events of a domain (and entity) in the last hours, in time order."""
    chain = _since(events, as_of, hours).filter(F.col("domain") == domain)
    if entity is not None:
        chain = chain.filter(F.col("entity") == entity)
    return chain.orderBy("event_ts", "event_id")


def replay(events: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """All events between two moments, both included."""
    return between(events, clock.moment(start), clock.moment(end))


def recent(
    events: DataFrame, as_of: Moment, hours: int = 24, module: str | None = None, event_type: str | None = None
) -> DataFrame:
    """Events of the last hours, optionally of one module or type."""
    found = _since(events, as_of, hours)
    if module is not None:
        found = found.filter(F.col("source_module") == module)
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    return found


def event_stats(events: DataFrame) -> DataFrame:
    """Total, by type and by module in one pass: rows (dimension, key, events)."""
    counted = events.groupingSets(
        [[], ["event_type"], ["source_module"]], "event_type", "source_module"
    ).agg(F.count("*").alias("events"), F.grouping("event_type").alias("_t"), F.grouping("source_module").alias("_m"))
    return counted.select(
        F.when(F.col("_t") == 0, F.lit("type")).when(F.col("_m") == 0, F.lit("module")).otherwise(F.lit("total")).alias("dimension"),
        F.coalesce("event_type", "source_module", F.lit("all")).alias("key"),
        "events",
    )


def causal_chain(events: DataFrame, queue: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """Figures of each (domain, entity) story in the window.

    The events themselves stay rows (``chain_narrative``): a story may be any length.
    ``open_approvals`` counts all pending requests.
    """
    kind = F.col("event_type")
    return (
        _since(events, as_of, hours)
        .groupBy("domain", "entity")
        .agg(
            F.count("*").alias("events"),
            F.min("event_ts").alias("first_event"),
            F.max("event_ts").alias("last_event"),
            _total(kind == "VALUE_CALCULATED", "exposure_usd").alias("total_exposure_usd"),
            _total(kind == "CORRECTION_APPLIED", "total_recovery_usd").alias("total_recovered_usd"),
        )
        .withColumn("open_approvals", pending_count(queue).scalar())
    )


def _total(rows: Column, path: str) -> Column:
    amount = F.coalesce(field(path).try_cast("double"), F.lit(0.0))
    return F.sum(F.when(rows, amount).otherwise(F.lit(0.0)))


def chain_narrative(events: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """One labelled line per event, to be read in (domain, entity, event_ts, event_id) order."""
    kind = F.col("event_type")
    unknown = F.lit("?")
    days = F.coalesce(field("days_since"), F.lit("0"))
    exposure = F.coalesce(field("exposure_usd").try_cast("double"), F.lit(0.0))
    detail = (
        F.when(kind == "STALENESS_DETECTED", F.concat(F.lit(" (level: "), F.coalesce(field("level"), unknown), F.lit(")")))
        .when(
            kind == "CONTEXT_INJECTED",
            F.concat(F.lit(" → value: "), F.coalesce(field("injected_value"), field("value"), unknown)),
        )
        .when(kind == "VALUE_CALCULATED", F.concat(F.lit(" → exposure: $"), F.format_number(exposure, 0)))
        .when(
            kind == "PIPELINE_FAILURE_FOUND",
            F.concat(F.lit(" ("), F.coalesce(field("failure_type"), unknown), F.lit(", "), days, F.lit("d ago)")),
        )
        .otherwise(F.lit(""))
    )
    labelled = _since(events, as_of, hours).join(
        dims.event_labels(events.sparkSession), "event_type", "left"
    )
    clock_time = F.substring(F.col("event_ts").cast("string"), 12, 5)
    line = F.concat(F.lit("  "), clock_time, F.lit(" UTC — "), F.coalesce("label", "event_type"), detail)
    return labelled.select("domain", "entity", "event_ts", "event_id", line.alias("line"))


def stack_health(events: DataFrame, queue: DataFrame, as_of: Moment, lead: str = "", hours: int = 24) -> DataFrame:
    """Status and counters of each module, one row per counter."""
    kind, module = F.col("event_type"), F.col("source_module")

    def seen(name: str, event_type: str | None = None) -> Column:
        rows = module == name
        return F.count_if(rows & (kind == event_type) if event_type else rows)

    totals = _since(events, as_of, hours).agg(
        F.count_if((kind == "STALENESS_DETECTED") & (F.col("severity") == "CRITICAL")).alias("critical"),
        seen("DKSM", "STALENESS_DETECTED").alias("detections"),
        seen("LCI", "CONTEXT_INJECTED").alias("injections"),
        seen("LCI").alias("injector_events"),
        seen("PP", "PIPELINE_FAILURE_FOUND").alias("failures"),
        seen("AVL", "VALUE_CALCULATED").alias("values"),
        seen("FLE", "CORRECTION_RECEIVED").alias("signals"),
        seen("FLE", "CORRECTION_APPLIED").alias("applied"),
    )
    waiting = queue.filter(F.col("status") == "pending").agg(
        F.count("*").alias("all"), F.count_if(module == "PP").alias("remediations")
    )
    counted = waiting.select(F.struct("all", "remediations")).scalar()
    totals = totals.withColumn("_w", counted).select("*", F.col("_w.all").alias("pending"), F.col("_w.remediations").alias("remediations"))
    lead_status = "OK" if lead else "WARNING"
    return totals.selectExpr(
        f"""stack(10,
        'DKSM', IF(critical > 0, 'CRITICAL', 'OK'), 'critical_count', detections,
        'LCI', 'OK', 'active_injections', injections,
        'LCI', 'OK', 'injection_rate_24h', injector_events,
        'PP', IF(failures > 0, 'WARNING', 'OK'), 'failures_found', failures,
        'PP', IF(failures > 0, 'WARNING', 'OK'), 'pending_remediations', remediations,
        'AVL', 'OK', 'value_events_24h', values,
        'FLE', 'OK', 'signals_24h', signals,
        'FLE', 'OK', 'applied_24h', applied,
        'ASGC', '{lead_status}', 'pending_approvals', pending,
        'ASGC', '{lead_status}', 'lead_configured', CAST({1 if lead else 0} AS BIGINT)
        ) AS (module, status, metric, value)"""
    )


def industry_of(events: DataFrame, industries: DataFrame) -> DataFrame:
    """Industry from the payload, else from the domain map, else General."""
    mapped = industries.select("domain", F.col("industry").alias("_mapped"))
    given = field("industry")
    return (
        events.join(mapped, "domain", "left")
        .withColumn("industry", F.coalesce(F.when(given != "", given), "_mapped", F.lit(C.DEFAULT_INDUSTRY)))
        .drop("_mapped")
    )


def event_timeline(events: DataFrame, industries: DataFrame, as_of: Moment, hours: int = 24, n: int = C.TIMELINE_ROWS) -> DataFrame:
    """The last n events of the window with industry and correction flag."""
    last = _since(events, as_of, hours).orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n)
    flag = F.coalesce(field("corrected"), field("error_corrected"))
    return industry_of(last, industries).select(
        "event_ts",
        "event_id",
        "source_module",
        "event_type",
        "domain",
        F.coalesce("entity", F.lit("")).alias("entity"),
        "industry",
        F.when(flag == "true", F.lit("yes")).when(flag == "false", F.lit("no")).otherwise(F.lit("—")).alias("corrected"),
        "severity",
    )


def expiry_cards(events: DataFrame, industries: DataFrame, as_of: Moment, hours: int = 24, n: int = C.EXPIRY_CARDS) -> DataFrame:
    """The n soonest expiries of the window; an alert without a day count sorts as 999."""
    alerts = _since(events, as_of, hours).filter(F.col("event_type").isin("EXPIRY_ALERT", "DATA_CONTRACT_EXPIRY"))
    days = F.coalesce(field("days_until_expiry").try_cast("int"), F.lit(999))
    soonest = alerts.withColumn("days_left", days).orderBy("days_left", "event_ts", "event_id").limit(n)
    return industry_of(soonest, industries).select(
        "event_id",
        "event_type",
        "domain",
        "entity",
        "industry",
        "days_left",
        F.coalesce(field("expiry_date"), F.lit("?")).alias("expiry_date"),
        F.coalesce(field("recommended_action"), F.lit("REVIEW")).alias("recommended_action"),
    )


def first_exposure_per_domain(events: DataFrame, as_of: Moment, hours: int = 24 * 30) -> DataFrame:
    """First non-zero calculated exposure per domain."""
    amount = field("exposure_usd").try_cast("double")
    valued = (
        _since(events, as_of, hours)
        .filter(F.col("event_type") == "VALUE_CALCULATED")
        .withColumn("exposure_usd", amount)
        .filter(F.col("exposure_usd") != 0)
    )
    return valued.groupBy("domain").agg(
        F.min_by("exposure_usd", F.struct("event_ts", "event_id")).alias("exposure_usd")
    )


def value_kpis(exposures: DataFrame, fix_cost: int = C.FIX_COST_USD, share: float = C.RECOVERABLE_SHARE) -> DataFrame:
    """Total, recovered, net value and return multiple in one row."""
    total = exposures.agg(F.coalesce(F.sum("exposure_usd"), F.lit(0.0)).alias("total_exposure_usd"))
    recovered = F.round(F.col("total_exposure_usd") * share, 0)
    return total.select(
        "total_exposure_usd",
        recovered.alias("recovered_usd"),
        (recovered - fix_cost).alias("net_value_usd"),
        F.round(recovered / fix_cost, 1).alias("roi_multiple"),
    )


# --- approvals -------------------------------------------------------------------


def queue_for_approval(events: DataFrame) -> DataFrame:
    """One pending request per event that asks for approval or is flagged."""
    asking = critical_escalation(events).filter((F.col("event_type") == "APPROVAL_REQUIRED") | F.col("requires_approval"))
    return asking.dropDuplicates(["event_id"]).select(
        F.concat(F.lit("REQ-"), "event_id").alias("request_id"),
        F.col("event_ts").alias("requested_at"),
        "source_module",
        "event_type",
        "domain",
        F.coalesce("entity", F.lit("")).alias("entity"),
        F.coalesce(field("action"), field("routing_action"), F.lit("review")).alias("proposed_action"),
        F.coalesce(field("risk_level"), F.lit("Medium")).alias("risk_level"),
        F.substring("payload", 1, C.SUMMARY_CHARS).alias("payload_summary"),
        F.lit("pending").alias("status"),
        F.lit("").alias("decided_by"),
        F.lit(None).cast("timestamp_ntz").alias("decided_at"),
    )


def decide_approvals(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the latest decision (request_id, decision, lead, decided_at, reason) to each request.

    ``reason`` may be missing; it is kept for rejections, empty where none was given, and
    null for all other requests.
    """
    reason = F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string")
    latest = decisions.withColumn("reason", reason).groupBy("request_id").agg(
        F.max_by(F.struct("decision", "lead", "decided_at", "reason"), F.struct("decided_at", "decision")).alias("_d")
    )
    return queue.join(latest, "request_id", "left").select(
        *[c for c in queue.columns if c not in ("status", "decided_by", "decided_at", "reason")],
        F.coalesce("_d.decision", "status").alias("status"),
        F.coalesce("_d.lead", "decided_by").alias("decided_by"),
        F.coalesce("_d.decided_at", "decided_at").alias("decided_at"),
        F.when(F.col("_d.decision") == "rejected", F.coalesce("_d.reason", F.lit(""))).alias("reason"),
    )


def decision_events(decided: DataFrame) -> DataFrame:
    """Granted and rejected events of decided requests."""
    granted = F.col("status") == "approved"
    payload = F.when(
        granted, F.to_json(F.struct("request_id", F.col("decided_by").alias("approved_by")))
    ).otherwise(F.to_json(F.struct("request_id", F.col("decided_by").alias("rejected_by"), "reason")))
    return decided.filter(F.col("status").isin("approved", "rejected")).select(
        F.concat(F.lit("DEC-"), "request_id").alias("event_id"),
        F.col("decided_at").alias("event_ts"),
        F.lit("ASGC").alias("source_module"),
        F.when(granted, F.lit("APPROVAL_GRANTED")).otherwise(F.lit("APPROVAL_REJECTED")).alias("event_type"),
        "domain",
        "entity",
        payload.alias("payload"),
        F.lit("INFO").alias("severity"),
        F.lit(False).alias("requires_approval"),
    )


def pending_approvals(queue: DataFrame) -> DataFrame:
    """Requests without a decision."""
    return queue.filter(F.col("status") == "pending")


def pending_count(queue: DataFrame) -> DataFrame:
    """Number of pending requests, one row."""
    return pending_approvals(queue).agg(F.count("*").alias("pending"))


def pending_by_risk(queue: DataFrame) -> DataFrame:
    """Pending requests per module and risk."""
    return pending_approvals(queue).groupBy("source_module", "risk_level").agg(F.count("*").alias("pending"))


def board_tables(health: DataFrame, queue: DataFrame, n: int = C.BOARD_ROWS) -> DataFrame:
    """Board report rows: the health counters, then the n oldest pending requests."""
    status = health.select(
        F.lit("health").alias("section"), F.col("module").alias("item"), F.col("metric").alias("detail"),
        F.col("status").alias("state"), F.col("value").cast("string").alias("figure"),
    )
    oldest = pending_approvals(queue).orderBy("requested_at", "request_id").limit(n)
    waiting = oldest.select(
        F.lit("pending").alias("section"), F.col("request_id").alias("item"),
        F.substring("proposed_action", 1, 30).alias("detail"), F.col("risk_level").alias("state"),
        F.substring(F.col("requested_at").cast("string"), 6, 11).alias("figure"),
    )
    return status.unionByName(waiting)
