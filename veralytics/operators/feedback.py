"""Correction signals: capture, classify, route, apply, measure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock
from veralytics.functions.numbers import ratio
from veralytics.functions.text import set_jaccard, space_set

Moment = datetime | str
# Texts that read as a decimal number.
_DECIMAL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(text: Column) -> Column:
    return F.when(text.rlike(_DECIMAL), F.trim(text).try_cast("double"))


def capture_signal(signals: DataFrame, min_confidence: float = C.MIN_SIGNAL_CONFIDENCE) -> DataFrame:
    """Normalise the type and set the status: classified when confident enough, else pending."""
    kind = F.col("signal_type")
    return signals.withColumn(
        "signal_type", F.when(kind.isin(*C.SIGNAL_TYPES), kind).otherwise(F.lit(C.DEFAULT_SIGNAL_TYPE))
    ).withColumn(
        "fle_status", F.when(F.col("confidence") >= min_confidence, F.lit("classified")).otherwise(F.lit("pending"))
    )


def signal_events(captured: DataFrame) -> DataFrame:
    """CORRECTION_RECEIVED event per classified signal."""
    return captured.filter(F.col("fle_status") == "classified").select(
        F.concat(F.lit("EVT-"), "signal_id").alias("event_id"),
        F.col("signal_ts").alias("event_ts"),
        F.lit("FLE").alias("source_module"),
        F.lit("CORRECTION_RECEIVED").alias("event_type"),
        "domain",
        "entity",
        F.to_json(F.struct("signal_id", "wrong_value", "correct_value", "signal_type")).alias("payload"),
        F.lit("INFO").alias("severity"),
        F.lit(False).alias("requires_approval"),
    )


def classify_error(wrong: Column, correct: Column) -> Column:
    """Error class of a correction.

    Numbers at least 20 % apart are a threshold error. Anything else, nearer numbers
    included, is judged by its tokens.
    """
    wn, cn = as_number(wrong), as_number(correct)
    apart = (cn != 0) & (F.abs(wn - cn) / F.abs(cn) >= C.THRESHOLD_REL_DIFF)
    wt, ct = space_set(wrong), space_set(correct)
    return (
        F.when(F.coalesce(apart, F.lit(False)), F.lit("THRESHOLD_ERROR"))
        .when((F.size(wt) <= 0) | (F.size(ct) <= 0), F.lit("CLASSIFICATION_ERROR"))
        .when(set_jaccard(wt, ct) < C.TOKEN_OVERLAP, F.lit("DEFINITION_ERROR"))
        .otherwise(F.lit("RETRIEVAL_ERROR"))
    )


def repeat_error_count(signals: DataFrame) -> DataFrame:
    """Signals per (domain, entity)."""
    return signals.groupBy("domain", "entity").agg(F.count("*").alias("repeats"))


def route_correction(
    signals: DataFrame, auto_propagate: bool = False, retrain_threshold: int = C.RETRAIN_THRESHOLD
) -> DataFrame:
    """Error class, action, approval need, boost and fine-tune flag per signal."""
    table = dims.routes(signals.sparkSession)
    needs = (F.col("approval") == "always") | ((F.col("approval") == "unless_auto") & F.lit(not auto_propagate))
    error = F.col("error_type")
    classed = signals.withColumn("error_type", classify_error(F.col("wrong_value"), F.col("correct_value")))
    pairs_due = (error == "DEFINITION_ERROR") & (F.col("repeats") >= retrain_threshold)
    return (
        classed.join(table, "error_type")
        .join(repeat_error_count(signals), ["domain", "entity"], "left")
        .withColumn("requires_approval", needs)
        .withColumn("fine_tune", F.coalesce(pairs_due, F.lit(False)))
        .withColumn("boost", F.when(error == "RETRIEVAL_ERROR", F.lit(C.BOOST)))
        .drop("approval")
    )


def finetune_pairs(routed: DataFrame) -> DataFrame:
    """Instruction and response of the signals that qualify."""
    return routed.filter("fine_tune").select(
        "signal_id",
        F.concat(F.lit("What is the current value for "), "entity", F.lit("?")).alias("instruction"),
        F.concat(
            F.lit("The current value for "), "entity", F.lit(" is "), "correct_value", F.lit(". Note: "), "wrong_value", F.lit(" is outdated.")
        ).alias("response"),
    )


def _touches_gold() -> Column:
    action = F.col("routing_action")
    return F.contains(action, F.lit("gold")) | F.contains(action, F.lit("reprobe"))


def apply_routing(routed: DataFrame, approvals: DataFrame) -> DataFrame:
    """Apply what needs no approval or has one (signal_id, approved_by); list the actions taken."""
    given = approvals.groupBy("signal_id").agg(F.min("approved_by").alias("approved_by"))
    joined = routed.drop("approved_by").join(given, "signal_id", "left").withColumn("approved_by", F.coalesce("approved_by", F.lit("")))
    applied = ~F.col("requires_approval") | (F.col("approved_by") != "")
    actions = F.array_compact(
        F.array(
            F.when(_touches_gold(), F.concat(F.lit("Gold layer flagged: "), "entity", F.lit(" → "), "correct_value")),
            F.when(F.col("fine_tune"), F.lit("Fine-tune pair written")),
            F.when(F.col("boost").isNotNull(), F.concat(F.lit("Retrieval boosted: "), "entity", F.lit(f" (boost={C.BOOST})"))),
        )
    )
    return (
        joined.withColumn("applied", applied)
        .withColumn("actions", F.when(applied, actions).otherwise(F.array().cast("array<string>")))
        .withColumn("fle_status", F.when(F.col("applied"), F.lit("applied")).otherwise(F.col("fle_status")))
        .withColumn("propagated", F.col("applied"))
    )


def routing_events(applied: DataFrame, as_of: Moment) -> DataFrame:
    """CORRECTION_APPLIED per applied signal, and REPROBE_REQUESTED where gold changed."""
    done = applied.filter("applied")
    kinds = F.array_compact(
        F.array(F.lit("CORRECTION_APPLIED"), F.when(_touches_gold(), F.lit("REPROBE_REQUESTED")))
    )
    payload = F.when(
        F.col("event_type") == "CORRECTION_APPLIED", F.to_json(F.struct("signal_id", "error_type", "actions", "approved_by"))
    ).otherwise(F.to_json(F.struct(F.lit("correction_applied").alias("triggered_by"), "signal_id")))
    return done.withColumn("event_type", F.explode(kinds)).select(
        F.concat("event_type", F.lit("-"), "signal_id").alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("FLE").alias("source_module"),
        "event_type",
        "domain",
        "entity",
        payload.alias("payload"),
        F.lit("INFO").alias("severity"),
        F.lit(False).alias("requires_approval"),
    )


def flag_gold(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """Flag gold rows of corrected entities and keep the newest corrected value."""
    newest = (
        corrections.filter(_touches_gold() & F.col("applied"))
        .groupBy("domain", "entity")
        .agg(F.max_by("correct_value", F.struct("signal_ts", "signal_id")).alias("_new"))
    )
    had = F.col("fle_flagged") if "fle_flagged" in gold.columns else F.lit(False)
    old = F.col("fle_correct_value") if "fle_correct_value" in gold.columns else F.lit(None).cast("string")
    return (
        gold.join(newest, ["domain", "entity"], "left")
        .withColumn("fle_flagged", F.coalesce(had, F.lit(False)) | F.col("_new").isNotNull())
        .withColumn("fle_correct_value", F.coalesce("_new", old))
        .drop("_new")
    )


def feedback_summary(signals: DataFrame) -> DataFrame:
    """Counts in total, by type and by domain, with applied and pending and the closure rate of each."""
    applied = F.count_if(F.col("fle_status") == "applied")
    grouped = signals.groupingSets([[], ["signal_type"], ["domain"]], "signal_type", "domain").agg(
        F.count("*").alias("signals"),
        applied.alias("applied"),
        F.count_if(F.col("fle_status") == "pending").alias("pending"),
        F.grouping("signal_type").alias("_t"),
        F.grouping("domain").alias("_d"),
    )
    return grouped.select(
        F.when(F.col("_t") == 0, F.lit("type")).when(F.col("_d") == 0, F.lit("domain")).otherwise(F.lit("total")).alias("dimension"),
        F.coalesce("signal_type", "domain", F.lit("all")).alias("key"),
        "signals",
        "applied",
        "pending",
        ratio(F.col("applied"), F.col("signals"), 3).alias("closure_rate"),
    )


def learning_velocity(signals: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Applied share, repeat reduction and alert over the window, one row."""
    recent = signals.filter(F.col("signal_ts") >= clock.moment(as_of) - clock.days(days))
    groups = recent.groupBy("domain", "entity").agg(
        F.count("*").alias("_n"), F.count_if(F.col("fle_status") == "applied").alias("_applied")
    )
    totals = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("signals"),
        F.coalesce(F.sum("_applied"), F.lit(0)).alias("applied"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("_largest"),
    )
    share = F.least(F.col("_largest") / F.greatest(F.col("signals"), F.lit(1)), F.lit(1.0))
    return totals.select(
        "signals",
        "applied",
        ratio(F.col("applied"), F.col("signals"), 3).alias("learning_velocity"),
        F.round(1.0 - share, 3).alias("repeat_error_reduction_rate"),
    ).withColumn("alert", F.col("learning_velocity") < C.LOW_VELOCITY)


def corrections_per_week(signals: DataFrame, as_of: Moment, days: int = 30, weeks: int = 4) -> DataFrame:
    """Signals in seven-day steps counted forward from the cutoff; empty weeks give 0."""
    cutoff = clock.moment(as_of) - clock.days(days)
    recent = signals.filter((F.col("signal_ts") >= cutoff) & (F.col("signal_ts") < cutoff + clock.days(7 * weeks)))
    week = clock.floor_div(clock.micros_between(cutoff, F.col("signal_ts")), 7 * clock.DAY_MICROS)
    counted = recent.groupBy(week.cast("int").alias("week")).agg(F.count("*").alias("_n"))
    every = signals.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week"))
    return every.join(counted, "week", "left").select("week", F.coalesce("_n", F.lit(0)).alias("signals"))


def weekly_improvement(signals: DataFrame, as_of: Moment) -> DataFrame:
    """Applied corrections of this and the previous seven days and the share of repeated entities."""
    at = clock.moment(as_of)
    ts = F.col("signal_ts")
    recent = signals.filter((ts >= at - clock.days(14)) & (ts < at))
    this_week = ts >= at - clock.days(7)
    applied = F.col("fle_status") == "applied"
    groups = recent.groupBy("domain", "entity").agg(
        F.count_if(this_week).alias("_n"),
        F.count_if(this_week & applied).alias("_this"),
        F.count_if(~this_week & applied).alias("_last"),
    )
    week = F.concat(F.date_format(at.cast("date"), "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    return groups.agg(
        F.coalesce(F.sum("_this"), F.lit(0)).alias("corrections_this_week"),
        F.coalesce(F.sum("_last"), F.lit(0)).alias("corrections_last_week"),
        F.count_if(F.col("_n") > 1).alias("_repeated"),
        F.count_if(F.col("_n") > 0).alias("_groups"),
    ).select(
        "corrections_this_week",
        "corrections_last_week",
        (F.col("corrections_this_week") - F.col("corrections_last_week")).alias("delta"),
        ratio(F.col("_repeated"), F.col("_groups"), 3).alias("repeat_error_rate"),
        week.alias("week_ending"),
    )


def improvement_event(weekly: DataFrame, as_of: Moment) -> DataFrame:
    """LEARNING_IMPROVEMENT event of a weekly comparison, for all domains."""
    body = F.struct("corrections_this_week", "corrections_last_week", "delta", "repeat_error_rate", "week_ending")
    return weekly.select(
        F.concat(F.lit("IMP-"), "week_ending").alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("FLE").alias("source_module"),
        F.lit("LEARNING_IMPROVEMENT").alias("event_type"),
        F.lit("all").alias("domain"),
        F.lit("").alias("entity"),
        F.to_json(body).alias("payload"),
        F.lit("INFO").alias("severity"),
        F.lit(False).alias("requires_approval"),
    )
