"""Value ledger: link injections to outcomes, price exposure and recovery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock
from veralytics.operators.spread import spread_join

Moment = datetime | str


def injection_outcome_link(injections: DataFrame, outcomes: DataFrame, hours: int = C.LINK_HOURS) -> DataFrame:
    """Distinct outcomes inside [t, t + hours] of any injection of the same domain.

    Time is cut into slots as long as the window, so an injection before outcome o lies in
    o's slot or the one before it. In the own slot one exists exactly when the slot's first
    injection is not after o; in the slot before, when its last one is not before o - hours.
    Two values per (domain, slot) therefore decide, whatever the number of injections, and no
    pair of injection and outcome is ever formed.
    """
    length = hours * clock.HOUR_MICROS

    def slot(ts: Column) -> Column:
        return clock.floor_div(clock.epoch_micros(ts), length)

    ends = injections.groupBy("domain", slot(F.col("injected_at")).alias("_slot")).agg(
        F.min("injected_at").alias("_first"), F.max("injected_at").alias("_last")
    )
    # One row per slot an outcome can fall in: the own slot's first and the slot before's last.
    decisive = (
        ends.select("domain", "_slot", "_first", F.lit(None).cast("timestamp_ntz").alias("_last"))
        .unionByName(ends.select("domain", (F.col("_slot") + 1).alias("_slot"), F.lit(None).cast("timestamp_ntz").alias("_first"), "_last"))
        .groupBy("domain", "_slot")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    )
    linked = outcomes.withColumn("_slot", slot(F.col("outcome_ts"))).join(decisive, ["domain", "_slot"])
    hit = (F.col("_first") <= F.col("outcome_ts")) | (F.col("_last") >= F.col("outcome_ts") - clock.hours(hours))
    return linked.filter(F.coalesce(hit, F.lit(False))).select(*outcomes.columns).dropDuplicates()


def recent_decisions(decisions: DataFrame, as_of: Moment, days: int) -> DataFrame:
    return decisions.filter(F.col("decided_at") >= clock.moment(as_of) - clock.days(days))


def count_decisions(domains: DataFrame, linked: DataFrame, decisions: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Decisions per domain: the linked outcomes if there are any, else the log rows of the window."""
    by_link = linked.groupBy("domain").agg(F.count("*").alias("_linked"))
    by_log = recent_decisions(decisions, as_of, days).groupBy("domain").agg(F.count("*").alias("_logged"))
    linked_rows = F.coalesce("_linked", F.lit(0))
    return (
        domains.select("domain")
        .join(by_link, "domain", "left")
        .join(by_log, "domain", "left")
        .select(
            "domain",
            F.when(linked_rows > 0, linked_rows).otherwise(F.coalesce("_logged", F.lit(0))).alias("total_decisions"),
        )
    )


def decisions_by_type(decisions: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Decisions per domain and outcome in the window."""
    return recent_decisions(decisions, as_of, days).groupBy("domain", "decision_outcome").agg(F.count("*").alias("decisions"))


def risk_category(domains: DataFrame) -> DataFrame:
    """Regulatory class of each domain; Limited when unlisted."""
    classes = dims.risk_categories(domains.sparkSession).withColumnRenamed("risk_category", "_class")
    return (
        domains.drop("risk_category")
        .join(classes, "domain", "left")
        .withColumn("risk_category", F.coalesce("_class", F.lit(C.DEFAULT_RISK_CATEGORY)))
        .drop("_class")
    )


def exposure(
    counts: DataFrame,
    days: int = 30,
    error_rate: float = C.ERROR_RATE,
    decision_value: int = C.AVG_DECISION_VALUE_USD,
) -> DataFrame:
    """Bad decisions, exposure, recovery potential and class from the decisions per domain."""
    bad = F.floor(F.col("total_decisions") * error_rate).cast("bigint")
    at_stake = F.round((F.col("estimated_bad_decisions") * decision_value).cast("double"), 2)
    return (
        risk_category(counts)
        .withColumn("failure_period_days", F.lit(days))
        .withColumn("estimated_bad_decisions", bad)
        .withColumn("financial_exposure_usd", at_stake)
        .withColumn("recovery_potential_usd", F.round(F.col("financial_exposure_usd") * C.RECOVERABLE_SHARE, 2))
    )


def recovery_value(outcomes: DataFrame, by: list[str] | None = None, fix_cost: int = C.FIX_COST_USD) -> DataFrame:
    """Outcome values before and after correction; money is summed in whole cents."""
    after = F.col("correction_applied")
    sums = outcomes.groupBy(*(by or [])).agg(
        F.count_if(~after).alias("decisions_before"),
        F.count_if(after).alias("decisions_after"),
        F.coalesce(F.sum(F.when(~after, F.col("value_cents"))), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.when(after, F.col("value_cents"))), F.lit(0)).alias("_after"),
    )

    def mean(cents: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(cents) / 100.0 / F.col(n)).otherwise(F.lit(0.0))

    delta = mean("_after", "decisions_after") - mean("_before", "decisions_before")
    total = F.round(delta * F.col("decisions_after"), 2)
    return sums.select(
        *(by or []),
        "decisions_before",
        "decisions_after",
        F.round(mean("_before", "decisions_before"), 2).alias("avg_value_before"),
        F.round(mean("_after", "decisions_after"), 2).alias("avg_value_after"),
        F.round(delta, 2).alias("value_delta"),
        F.greatest(total, F.lit(0.0)).alias("total_recovery_usd"),
        F.greatest(F.round(total / fix_cost, 2), F.lit(0.0)).alias("roi_multiplier"),
    )


def value_by_domain(domains: DataFrame, exposures: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Exposure, recovery and return of every domain."""
    return (
        domains.select("domain", "domain_id")
        .join(exposures.select("domain", "financial_exposure_usd"), "domain", "left")
        .join(recoveries.select("domain", "total_recovery_usd", "roi_multiplier"), "domain", "left")
        .select(
            "domain",
            "domain_id",
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("financial_exposure_usd", "total_recovery_usd", "roi_multiplier")],
        )
    )


def value_summary(by_domain: DataFrame, fix_cost: int = C.FIX_COST_USD) -> DataFrame:
    """Totals, net value and best domain (the first in configuration order on ties)."""
    return by_domain.agg(
        F.round(F.sum("financial_exposure_usd"), 2).alias("total_exposure_usd"),
        F.round(F.sum("total_recovery_usd"), 2).alias("total_recovered_usd"),
        F.round(F.sum("total_recovery_usd") - fix_cost * F.count("*"), 2).alias("net_value_usd"),
        F.max_by("domain", F.struct(F.col("roi_multiplier"), -F.col("domain_id"))).alias("top_domain"),
    )


def tag_injection(outcomes: DataFrame, injections: DataFrame, hours: int | None = None) -> DataFrame:
    """Mark uncorrected outcomes of injected domains as corrected.

    Without ``hours`` every outcome of an injected domain counts; with it only those that
    follow an injection by at most so many hours.
    """
    if hours is None:
        touched = injections.select("domain").distinct().withColumn("_hit", F.lit(True))
        joined = spread_join(outcomes, touched, ["domain"], ["outcome_id"], "left")
    else:
        hits = injection_outcome_link(injections, outcomes, hours).select("outcome_id").distinct().withColumn("_hit", F.lit(True))
        joined = outcomes.join(hits, "outcome_id", "left")
    tagged = F.coalesce("_hit", F.lit(False)) & ~F.col("correction_applied")
    return joined.withColumn("tagged", tagged).withColumn(
        "correction_applied", F.col("correction_applied") | F.col("tagged")
    ).drop("_hit")


def value_event(exposures: DataFrame, as_of: Moment) -> DataFrame:
    """VALUE_CALCULATED event per exposure."""
    payload = F.struct(
        F.col("financial_exposure_usd").alias("exposure_usd"),
        F.col("estimated_bad_decisions").alias("bad_decisions"),
        "risk_category",
        F.col("recovery_potential_usd").alias("recovery_potential"),
    )
    return exposures.select(
        F.md5(F.concat_ws("|", F.lit("VALUE_CALCULATED"), "domain", clock.moment(as_of).cast("string"))).alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("AVL").alias("source_module"),
        F.lit("VALUE_CALCULATED").alias("event_type"),
        "domain",
        F.lit("").alias("entity"),
        F.to_json(payload).alias("payload"),
        F.when(F.col("risk_category") == "High", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("severity"),
        F.lit(False).alias("requires_approval"),
    )


def recovery_timeline(outcomes: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Corrected value per day and domain."""
    recent = outcomes.filter((F.col("outcome_ts") >= clock.moment(as_of) - clock.days(days)) & F.col("correction_applied"))
    return recent.groupBy(F.col("outcome_ts").cast("date").alias("day"), "domain").agg(F.sum("value_cents").alias("value_cents"))
