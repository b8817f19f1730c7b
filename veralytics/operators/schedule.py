"""Schedules, expiry and notification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock
from veralytics.operators.events import field, industry_of
from veralytics.operators.medallion import gold_current
from veralytics.operators.scoring import freshness_probe
from veralytics.operators.spread import spread_join

Moment = datetime | str


def _timed(schedule: DataFrame, state: DataFrame, as_of: Moment) -> DataFrame:
    """Schedule rows with interval and elapsed seconds; either may be null."""
    intervals = dims.schedules(schedule.sparkSession)
    elapsed = clock.micros_between(F.col("last_run"), clock.moment(as_of)) / 1e6
    return schedule.join(state, "domain_key", "left").join(intervals, "schedule", "left").withColumn("_elapsed", elapsed)


def _due() -> Column:
    interval = F.col("interval_seconds")
    return (
        F.when(interval.isNull(), F.lit(False))
        .when(F.col("_elapsed").isNull(), F.lit(True))
        .otherwise(F.col("_elapsed") >= interval)
    )


def due_domains(schedule: DataFrame, state: DataFrame, as_of: Moment) -> DataFrame:
    """Domain keys to probe now: never run, or the interval has passed; manual ones never."""
    return _timed(schedule, state, as_of).filter(_due()).select("domain_key", "schedule", "last_run")


def _next_run() -> Column:
    interval = F.col("interval_seconds")
    left = F.greatest(interval - F.col("_elapsed"), F.lit(0.0))
    whole_hours, minutes = F.floor(left / 3600), F.floor(left / 60)
    return (
        F.when(interval.isNull(), F.lit("manual only"))
        .when(F.col("_elapsed").isNull(), F.lit("overdue — never run"))
        .when(left < 60, F.lit("due now"))
        .when(left < 3600, F.concat(F.lit("in "), minutes.cast("string"), F.lit(" min")))
        .otherwise(
            F.concat(
                F.lit("in "), whole_hours.cast("string"), F.lit("h "), (minutes - whole_hours * 60).cast("string"), F.lit("m")
            )
        )
    )


def next_run(schedule: DataFrame, state: DataFrame, as_of: Moment) -> DataFrame:
    """Readable time to the next run."""
    return _timed(schedule, state, as_of).select("domain_key", "schedule", _next_run().alias("next_run"))


def status_table(schedule: DataFrame, state: DataFrame, labels: DataFrame, as_of: Moment) -> DataFrame:
    """Company, domain, schedule, last and next run and due flag of each domain key."""
    timed = _timed(schedule, state, as_of).join(labels, "domain_key", "left")
    return timed.select(
        "domain_key",
        F.coalesce("company_name", F.element_at(F.split("domain_key", "__"), 1)).alias("company"),
        F.coalesce("domain_name", "domain_key").alias("domain"),
        "schedule",
        F.coalesce(F.col("last_run").cast("string"), F.lit("never")).alias("last_run"),
        _next_run().alias("next_run"),
        _due().alias("due_now"),
    )


def recent_results(log: DataFrame, n: int = C.RECENT_ROWS, domain_key: str | None = None) -> DataFrame:
    """The last n log rows by completion time, then entity."""
    rows = log if domain_key is None else log.filter(F.col("domain_key") == domain_key)
    return rows.orderBy(F.desc("completed_at"), F.desc("domain_key"), F.desc("entity")).limit(n)


def reprobe_requests(events: DataFrame, gold: DataFrame, domains: DataFrame, as_of: Moment) -> DataFrame:
    """Probe again all current facts of the domains that REPROBE_REQUESTED events name."""
    asked = events.filter(F.col("event_type") == "REPROBE_REQUESTED").select("domain").distinct()
    facts = spread_join(gold, asked, ["domain"], ["entity"], "left_semi")
    return freshness_probe(facts, domains, as_of, triggered_by="reprobe_after_correction")


# --- expiry ----------------------------------------------------------------------


def expiry_day(text: Column) -> Column:
    """An ISO day; anything else is null."""
    day = F.trim(text.cast("string"))
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def expiry_scan(
    gold: DataFrame,
    industries: DataFrame,
    warn_days: DataFrame,
    today: str,
    default_warn: int = C.EXPIRY_WARN_DAYS,
    critical_days: int = C.EXPIRY_CRITICAL_DAYS,
) -> DataFrame:
    """Alerts for current facts that have expired or will within the industry's warning days."""
    mapped = industries.select("domain", F.col("industry").alias("_mapped"))
    rows = gold_current(gold).withColumn("_day", expiry_day(F.col("expiry_date"))).filter(F.col("_day").isNotNull())
    own = F.col("industry") if "industry" in gold.columns else F.lit(None).cast("string")
    left = F.date_diff("_day", F.lit(today).cast("date"))
    placed = (
        rows.join(mapped, "domain", "left")
        .withColumn("industry", F.coalesce(own, "_mapped", F.lit(C.DEFAULT_INDUSTRY)))
        .join(warn_days, "industry", "left")
        .withColumn("days_until_expiry", left)
    )
    days = F.col("days_until_expiry")
    level = (
        F.when(days < 0, F.lit("EXPIRED"))
        .when(days <= critical_days, F.lit("EXPIRING_SOON"))
        .when(days <= F.coalesce("warn_days", F.lit(default_warn)), F.lit("EXPIRING"))
    )
    return placed.withColumn("level", level).filter(F.col("level").isNotNull()).select(
        "domain",
        "entity",
        "industry",
        "expiry_date",
        "days_until_expiry",
        "level",
        F.when(F.col("level") == "EXPIRING", F.lit("WARNING")).otherwise(F.lit("CRITICAL")).alias("severity"),
        F.coalesce("recommended_action", F.lit("REVIEW")).alias("recommended_action"),
    )


def expiry_events(alerts: DataFrame, as_of: Moment) -> DataFrame:
    """EXPIRY_ALERT event per alert."""
    critical = F.col("severity") == "CRITICAL"
    payload = F.struct("domain", "entity", "industry", "expiry_date", "days_until_expiry", "level", "severity", "recommended_action")
    return alerts.select(
        F.md5(F.concat_ws("|", F.lit("EXPIRY_ALERT"), "domain", "entity", clock.moment(as_of).cast("string"))).alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("DKSM").alias("source_module"),
        F.lit("EXPIRY_ALERT").alias("event_type"),
        "domain",
        "entity",
        F.to_json(payload).alias("payload"),
        "severity",
        critical.alias("requires_approval"),
    )


def expiry_approvals(alerts: DataFrame, as_of: Moment) -> DataFrame:
    """Approval requests for alerts whose action is REMOVE or UPDATE."""
    action = F.col("recommended_action")
    payload = F.struct("expiry_date", "days_until_expiry", "industry", "recommended_action")
    return alerts.filter(action.isin("REMOVE", "UPDATE")).select(
        F.concat(F.lit("REQ-"), F.md5(F.concat_ws("|", "domain", "entity", clock.moment(as_of).cast("string")))).alias("request_id"),
        clock.moment(as_of).alias("requested_at"),
        F.lit("DKSM").alias("source_module"),
        F.lit("EXPIRY_ACTION_REQUIRED").alias("event_type"),
        "domain",
        "entity",
        F.concat(action, F.lit("_EXPIRED_RECORD")).alias("proposed_action"),
        F.when(action == "REMOVE", F.lit("Medium")).otherwise(F.lit("Low")).alias("risk_level"),
        F.substring(F.to_json(payload), 1, C.SUMMARY_CHARS).alias("payload_summary"),
        F.lit("pending").alias("status"),
        F.lit("").alias("decided_by"),
        F.lit(None).cast("timestamp_ntz").alias("decided_at"),
    )


def stale_action_queue(gold: DataFrame, today: str) -> DataFrame:
    """Current facts that need an action, soonest expiry first, facts without expiry last."""
    day = expiry_day(F.col("expiry_date"))
    reason = F.col("staleness_reason")
    dash = F.lit("—")
    return (
        gold_current(gold)
        .filter(F.coalesce("recommended_action", F.lit("NONE")) != "NONE")
        .select(
            "domain",
            "entity",
            F.coalesce("industry", F.lit(C.DEFAULT_INDUSTRY)).alias("industry"),
            "recommended_action",
            F.when(F.coalesce("expiry_date", F.lit("")) != "", F.col("expiry_date")).otherwise(dash).alias("expiry_date"),
            F.date_diff(day, F.lit(today).cast("date")).alias("days_until_expiry"),
            "model_belief",
            F.when(F.coalesce(reason, F.lit("")) != "", F.substring(reason, 1, C.REASON_CHARS)).otherwise(dash).alias("staleness_reason"),
        )
        .orderBy(F.asc_nulls_last("days_until_expiry"), "domain", "entity")
    )


# --- notification ------------------------------------------------------------------


def notify_filter(events: DataFrame, watched: tuple[str, ...] = C.NOTIFY_TYPES) -> DataFrame:
    """Watched events; staleness only from WARNING up."""
    noisy = (F.col("event_type") == "STALENESS_DETECTED") & ~F.col("severity").isin("CRITICAL", "WARNING")
    return events.filter(F.col("event_type").isin(*watched) & ~noisy)


def digest(events: DataFrame, industries: DataFrame, hours: int = C.DIGEST_HOURS) -> DataFrame:
    """Counts and subject line per industry and interval."""
    placed = industry_of(notify_filter(events), industries)
    grouped = placed.groupBy(F.window("event_ts", f"{hours} hours").alias("_w"), "industry").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("severity") == "CRITICAL").alias("criticals"),
        F.count_if(F.col("event_type") == "EXPIRY_ALERT").alias("expiries"),
    )
    return digest_subject(grouped.select(F.col("_w.start").alias("window_start"), "industry", "events", "criticals", "expiries"))


def digest_subject(counts: DataFrame) -> DataFrame:
    parts = F.concat_ws(
        ", ",
        F.when(F.col("criticals") > 0, F.concat(F.col("criticals").cast("string"), F.lit(" CRITICAL"))),
        F.when(F.col("expiries") > 0, F.concat(F.col("expiries").cast("string"), F.lit(" expiring"))),
    )
    tag = F.when(parts != "", parts).otherwise(F.concat(F.col("events").cast("string"), F.lit(" events")))
    return counts.withColumn("subject", F.concat("industry", F.lit(" — "), tag))


def digest_lines(events: DataFrame, industries: DataFrame, hours: int = C.DIGEST_HOURS) -> DataFrame:
    """The body of each digest, one row per event, to be read in time order."""
    placed = industry_of(notify_filter(events), industries)
    kind, severity = F.col("event_type"), F.col("severity")
    what = F.concat(F.lit("["), severity, F.lit("] "), "domain", F.lit(" / "), F.coalesce("entity", F.lit("")))

    def given(path: str, default: str) -> Column:
        return F.coalesce(field(path), F.lit(default))

    line = (
        F.when(
            kind == "EXPIRY_ALERT",
            F.concat(
                F.lit("EXPIRY "), what, F.lit(" | Expires: "), given("expiry_date", "unknown"), F.lit(" ("), given("days_until_expiry", "?"),
                F.lit(" days) | Recommended action: "), given("recommended_action", "REVIEW"),
            ),
        )
        .when(kind == "DATA_CONTRACT_EXPIRY", F.concat(F.lit("DATA CONTRACT EXPIRY "), what, F.lit(" | "), given("detail", "")))
        .when(
            kind == "STALENESS_DETECTED",
            F.concat(
                F.lit("STALE "), what, F.lit(" | AI believes: "), given("belief", "?"), F.lit(" | Warehouse: "), given("truth", "?"),
                F.lit(" | "), given("days_since_update", "?"), F.lit(" days stale"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("PIPELINE ["), severity, F.lit("] "), given("dbt_model", "unknown"), F.lit(" | Failure: "),
                given("failure_type", "unknown"), F.lit(" | Domain: "), "domain",
            )
        )
    )
    start = F.window("event_ts", f"{hours} hours").getField("start")
    return placed.select(start.alias("window_start"), "industry", "event_ts", "event_id", line.alias("line"))


def notification_log(events: DataFrame, industries: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per notified event with the industry's recipients, the default ones, or log_only.

    ``groups`` (industry, recipients ARRAY); the industry ``default`` is the fallback. Make
    them by ``dims.fixed``: with a table of unknown size the whole log is shuffled by industry.
    """
    listed = groups.select("industry", F.when(F.size("recipients") > 0, F.array_join("recipients", ";")).alias("_to"))
    fallback = listed.filter(F.col("industry") == "default").agg(F.max("_to").alias("_to")).scalar()
    placed = industry_of(notify_filter(events), industries)
    return placed.join(listed, "industry", "left").select(
        "event_ts",
        "event_id",
        "event_type",
        "domain",
        "entity",
        "industry",
        "severity",
        F.lit("log").alias("channel"),
        F.coalesce("_to", fallback, F.lit(C.LOG_ONLY)).alias("recipients"),
    )
