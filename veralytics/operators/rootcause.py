"""Find the failed run behind a stale value."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock
from veralytics.operators.median import exact_median
from veralytics.operators.spread import spread_join

Moment = datetime | str


def run_log_union(artifact_runs: DataFrame, history: DataFrame) -> DataFrame:
    """Artifact rows and history rows together, exact duplicates removed."""
    return artifact_runs.unionByName(history, allowMissingColumns=True).dropDuplicates()


def in_lookback(runs: DataFrame, as_of: Moment, days: int = C.LOOKBACK_DAYS) -> DataFrame:
    return runs.filter(F.col("run_timestamp") >= clock.moment(as_of) - clock.days(days))


def hard_failure(runs: DataFrame) -> DataFrame:
    """Last failed run per model."""
    return runs.filter(F.col("status") == "failed").groupBy("dbt_model").agg(F.max("run_timestamp").alias("failed_at"))


def silent_drop(runs: DataFrame) -> DataFrame:
    """Earliest run below 70 % of the model's median row count, with the missing share."""
    rows = runs.select("dbt_model", "run_timestamp", "run_id", F.col("rows_affected").try_cast("double").alias("rows"))
    median = exact_median(rows, "dbt_model", "rows").filter(F.col("median") > 0)
    low = spread_join(rows, median, ["dbt_model"], ["run_timestamp", "run_id"]).filter(F.col("rows") < F.col("median") * C.DROP_RATIO)
    first = F.min(F.struct("run_timestamp", "run_id", "rows", "median")).alias("_r")
    return low.groupBy("dbt_model").agg(first).select(
        "dbt_model",
        F.col("_r.run_timestamp").alias("dropped_at"),
        F.round((F.col("_r.median") - F.col("_r.rows")) / F.col("_r.median"), 3).alias("drop_fraction"),
    )


def schema_drift(runs: DataFrame) -> DataFrame:
    """Earliest run whose version differs from the model's first, if there is more than one version."""
    first = runs.groupBy("dbt_model").agg(
        F.min_by("schema_version", F.struct("run_timestamp", "run_id")).alias("_first"),
        (F.min("schema_version") != F.max("schema_version")).alias("_mixed"),
    )
    changed = spread_join(runs, first.filter("_mixed"), ["dbt_model"], ["run_timestamp", "run_id"]).filter(~F.col("schema_version").eqNullSafe(F.col("_first")))
    return changed.groupBy("dbt_model").agg(F.min("run_timestamp").alias("drifted_at"))


def run_gap(runs: DataFrame, gap_hours: int = C.GAP_HOURS) -> DataFrame:
    """Start of the first step between runs that is longer than the gap.

    Runs of one slot as long as the gap cannot be a gap apart, so the ends of each slot are
    enough: one row per slot instead of one per run.
    """
    length = gap_hours * clock.HOUR_MICROS
    slot = clock.floor_div(clock.epoch_micros(F.col("run_timestamp")), length)
    ends = runs.groupBy("dbt_model", slot.alias("_slot")).agg(
        F.min("run_timestamp").alias("_from"), F.max("run_timestamp").alias("_to")
    )
    following = F.lead("_from").over(W.partitionBy("dbt_model").orderBy("_slot"))
    wide = ends.withColumn("_next", following).filter(clock.micros_between(F.col("_to"), F.col("_next")) > length)
    return wide.groupBy("dbt_model").agg(F.min("_to").alias("gap_at"))


def detect_failure(runs: DataFrame, as_of: Moment, lookback_days: int = C.LOOKBACK_DAYS) -> DataFrame:
    """One class per model: hard failure, silent drop, schema drift, gap, unknown, in that order."""
    recent = in_lookback(runs, as_of, lookback_days)
    active = recent.select("dbt_model").distinct().withColumn("_active", F.lit(True))
    joined = (
        runs.select("dbt_model")
        .distinct()
        .join(active, "dbt_model", "left")
        .join(hard_failure(recent), "dbt_model", "left")
        .join(silent_drop(recent), "dbt_model", "left")
        .join(schema_drift(recent), "dbt_model", "left")
        .join(run_gap(recent), "dbt_model", "left")
    )
    order = [("hard_failure", "failed_at"), ("silent_drop", "dropped_at"), ("schema_drift", "drifted_at"), ("gap", "gap_at")]
    kind: Column = F.when(F.col("_active").isNull(), F.lit("gap"))
    for name, at in order:
        kind = kind.when(F.col(at).isNotNull(), F.lit(name))
    return joined.select(
        "dbt_model",
        kind.otherwise(F.lit("unknown")).alias("failure_type"),
        F.coalesce(*[F.col(at) for _, at in order]).alias("failure_timestamp"),
        F.when(F.col("failed_at").isNull(), F.col("drop_fraction")).alias("drop_fraction"),
    )


def remediation_options(classes: DataFrame) -> DataFrame:
    """Options of each failure class; an unlisted class gets those of unknown."""
    options = dims.remediation_options(classes.sparkSession).withColumnRenamed("failure_type", "_class")
    listed = sorted({row[0] for row in C.REMEDIATION_OPTIONS})
    key = F.when(F.col("failure_type").isin(*listed), F.col("failure_type")).otherwise(F.lit("unknown"))
    return classes.withColumn("_class", key).join(options, "_class").drop("_class")


def downstream_domains(mapping: DataFrame) -> DataFrame:
    """All other mapped domains of each domain.

    The pipeline map is a configuration table (a row per domain), so the list of all its
    domains is small by nature.
    """
    everything = mapping.agg(F.array_sort(F.collect_set("domain"))).scalar()
    return mapping.withColumn("downstream", F.array_except(everything, F.array("domain")))


def root_cause_report(mapping: DataFrame, runs: DataFrame, as_of: Moment, lookback_days: int = C.LOOKBACK_DAYS) -> DataFrame:
    """One report per mapped domain; a model without runs gives the unknown report."""
    found = detect_failure(runs, as_of, lookback_days)
    joined = downstream_domains(mapping).join(found, "dbt_model", "left")
    has_runs = F.col("failure_type").isNotNull()
    days = F.when(F.col("failure_timestamp").isNotNull(), clock.days_since(F.col("failure_timestamp"), as_of)).otherwise(F.lit(0))
    report = joined.select(
        "domain",
        "dbt_model",
        F.coalesce("owner", F.lit(C.DEFAULT_OWNER)).alias("owner"),
        F.coalesce("failure_type", F.lit("unknown")).alias("failure_type"),
        "failure_timestamp",
        days.alias("days_since_failure"),
        "drop_fraction",
        F.when(has_runs, F.col("downstream")).otherwise(F.array().cast("array<string>")).alias("downstream"),
    )
    return remediation_options(report)


def failure_event(reports: DataFrame, as_of: Moment) -> DataFrame:
    """Event per report with a known class; WARNING below 30 days, else CRITICAL."""
    fresh = F.col("days_since_failure") < C.CRITICAL_AFTER_DAYS
    payload = F.struct("dbt_model", "failure_type", F.col("days_since_failure").alias("days_since"), "requires_approval")
    return reports.filter(F.col("failure_type") != "unknown").select(
        F.md5(F.concat_ws("|", F.lit("PIPELINE_FAILURE_FOUND"), "domain", clock.moment(as_of).cast("string"))).alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("PP").alias("source_module"),
        F.lit("PIPELINE_FAILURE_FOUND").alias("event_type"),
        "domain",
        F.lit("").alias("entity"),
        F.to_json(payload).alias("payload"),
        F.when(fresh, F.lit("WARNING")).otherwise(F.lit("CRITICAL")).alias("severity"),
        (~fresh).alias("requires_approval"),
    )


def run_health(reports: DataFrame) -> DataFrame:
    """Totals over all reports."""
    failed = F.col("failure_type") != "unknown"
    return reports.agg(
        F.count("*").alias("total_domains"),
        F.count_if(failed).alias("failures_found"),
        F.count_if(failed & F.col("requires_approval")).alias("pending_remediations"),
    )


def remediation_gate(requests: DataFrame) -> DataFrame:
    """High-risk requests without an approver wait; all others are executed.

    ``requests`` (request_id, domain, action, risk_level, approved_by).
    """
    approver = F.coalesce("approved_by", F.lit(""))
    waits = (F.col("risk_level") == "High") & (approver == "")
    return requests.withColumn("status", F.when(waits, F.lit("pending_approval")).otherwise(F.lit("executed"))).withColumn(
        "approved_by", F.when(waits, F.lit(None)).when(approver == "", F.lit("auto")).otherwise(approver)
    )


def remediation_outputs(gated: DataFrame, mapping: DataFrame, as_of: Moment) -> tuple[DataFrame, DataFrame]:
    """(approval events of waiting requests, success rows for the run log of executed ones)."""
    at = clock.moment(as_of)
    events = gated.filter(F.col("status") == "pending_approval").select(
        F.concat(F.lit("REM-"), F.col("request_id").cast("string")).alias("event_id"),
        at.alias("event_ts"),
        F.lit("PP").alias("source_module"),
        F.lit("APPROVAL_REQUIRED").alias("event_type"),
        "domain",
        F.lit("").alias("entity"),
        F.to_json(F.struct("action", "risk_level")).alias("payload"),
        F.lit("WARNING").alias("severity"),
        F.lit(True).alias("requires_approval"),
    )
    model = F.coalesce("dbt_model", F.concat(F.lit("fct_"), "domain"))
    runs = (
        gated.filter(F.col("status") == "executed")
        .join(mapping.select("domain", "dbt_model"), "domain", "left")
        .select(
            F.concat(F.lit("SIM-"), F.col("request_id").cast("string")).alias("run_id"),
            model.alias("dbt_model"),
            "domain",
            at.alias("run_timestamp"),
            F.lit("success").alias("status"),
            F.lit(C.REMEDIATED_RUN["duration_seconds"]).alias("duration_seconds"),
            F.lit(C.REMEDIATED_RUN["rows_affected"]).cast("bigint").alias("rows_affected"),
            F.lit("").alias("error_message"),
            F.lit(C.REMEDIATED_RUN["schema_version"]).alias("schema_version"),
            F.concat("domain", F.lit("_raw")).alias("source_table"),
        )
    )
    return events, runs
