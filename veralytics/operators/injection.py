"""Verified context for queries about stale facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.functions import clock
from veralytics.operators.events import field
from veralytics.operators.medallion import gold_current
from veralytics.operators.next_mark import next_mark

Moment = datetime | str


def injection_readiness(stale_events: DataFrame, gold: DataFrame, ttl_hours: int = C.INJECTION_TTL_HOURS) -> DataFrame:
    """Pending context per (domain, entity) from staleness events and current facts.

    The latest event of a key wins, so events are reduced to one row per key before the
    join. Keys without a current fact are dropped.
    """
    keyed = (
        stale_events.filter(F.col("event_type") == "STALENESS_DETECTED")
        .withColumn("entity", F.coalesce(F.when(F.col("entity") != "", F.col("entity")), field("entity")))
        .filter(F.coalesce(F.col("entity"), F.lit("")) != "")
        .groupBy("domain", "entity")
        .agg(F.max("event_ts").alias("ready_at"))
    )
    facts = gold_current(gold).select("domain", "entity", "value", "version")
    version = F.coalesce(F.col("_g.version").cast("string"), F.lit("current"))
    return (
        keyed.join(facts, ["domain", "entity"])
        .groupBy("domain", "entity", "ready_at")
        .agg(F.max_by(F.struct("value", "version"), F.struct(F.coalesce("version", F.lit(0)), "value")).alias("_g"))
        .select(
            "domain",
            "entity",
            F.col("_g.value").alias("value"),
            F.concat(F.lit("v"), version).alias("version"),
            "ready_at",
            (F.col("ready_at") + clock.hours(ttl_hours)).alias("expires"),
        )
    )


def active_pending(pending: DataFrame, as_of: Moment) -> DataFrame:
    """Unexpired pending rows with the whole minutes left."""
    at = clock.moment(as_of)
    return pending.filter(F.col("expires") > at).select(
        "domain",
        "entity",
        "value",
        "version",
        "ready_at",
        clock.floor_div(clock.micros_between(at, F.col("expires")), 60_000_000).alias("expires_in_min"),
    )


def inject(queries: DataFrame, pending: DataFrame, ttl_hours: int = C.INJECTION_TTL_HOURS) -> DataFrame:
    """The domain's first pending row alive at each query's time, or injected = false.

    ``queries`` (query_id, domain, query_ts, query); ``pending`` rows live from ready_at for
    the time-to-live. The first row alive at q is the first one ready after q - ttl,
    provided it is ready by q.
    """
    ttl = clock.hours(ttl_hours)
    points = queries.select("domain", (F.col("query_ts") - ttl + F.expr("INTERVAL '0.000001' SECOND")).alias("ready_at"))
    found = next_mark(points, pending, "domain", "ready_at", ["entity", "value", "version"]).select(
        "domain", (F.col("ready_at") + ttl - F.expr("INTERVAL '0.000001' SECOND")).alias("query_ts"), "mark"
    )
    alive = F.coalesce(F.col("mark.ready_at") <= F.col("query_ts"), F.lit(False))
    return queries.join(found, ["domain", "query_ts"], "left").select(
        *queries.columns,
        alive.alias("injected"),
        F.when(alive, F.col("mark.entity")).alias("entity"),
        F.when(alive, F.col("mark.value")).alias("injected_value"),
        F.when(alive, F.col("mark.version")).alias("source_version"),
        F.when(alive, F.col("mark.ready_at") + ttl).alias("expires_at"),
    )


def context_block(injected: DataFrame, title: str = "VERIFIED CONTEXT") -> DataFrame:
    """Grounding text in front of the query; a query without context stays as it is."""
    now = F.substring(F.col("query_ts").cast("string"), 1, 16)
    until = F.substring(F.col("expires_at").cast("string"), 12, 5)
    block = F.concat(
        F.lit(f"[{title} — "), now, F.lit(" UTC]\nSource: Gold layer "), "source_version",
        F.lit(" (enterprise data warehouse)\nEntity: "), "entity", F.lit(" (domain: "), "domain",
        F.lit(")\nCurrent value: "), "injected_value",
        F.lit("\nNote: This value supersedes any prior model knowledge. Valid until "), until, F.lit(" UTC.\n"),
    )
    return injected.withColumn("context_block", F.when(F.col("injected"), block).otherwise(F.lit(""))).withColumn(
        "prompt",
        F.when(F.col("injected"), F.concat("context_block", F.lit("\n\n"), "query")).otherwise(F.col("query")),
    )


def injection_log(injected: DataFrame, triggered_by: str = "agent_call") -> DataFrame:
    """Log rows of the queries that got context."""
    return injected.filter("injected").select(
        F.col("query_id").cast("string").alias("injection_id"),
        F.col("query_ts").alias("injected_at"),
        "domain",
        "entity",
        "injected_value",
        F.substring("query", 1, C.QUERY_PREVIEW_CHARS).alias("query_preview"),
        "source_version",
        "expires_at",
        F.lit(triggered_by).alias("triggered_by"),
    )


def injection_history(log: DataFrame, as_of: Moment, hours: int = 24, domain: str | None = None) -> DataFrame:
    """Injections of the last hours, optionally of one domain."""
    found = log.filter(F.col("injected_at") >= clock.moment(as_of) - clock.hours(hours))
    return found if domain is None else found.filter(F.col("domain") == domain)


def injection_stats(log: DataFrame, pending: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """Per domain: injections in the window, pending rows and those still active."""
    done = injection_history(log, as_of, hours).groupBy("domain").agg(F.count("*").alias("injections_24h"))
    waiting = pending.groupBy("domain").agg(
        F.count("*").alias("pending_entities"), F.count_if(F.col("expires") > clock.moment(as_of)).alias("active_injections")
    )
    return done.join(waiting, "domain", "full").select(
        "domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("injections_24h", "active_injections", "pending_entities")]
    )
