"""Staleness scores and what is built on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics import config as C
from veralytics.dims import fixed
from veralytics.functions import clock, text
from veralytics.functions.numbers import extract_number
from veralytics.operators.medallion import entity_lookup, gold_current
from veralytics.operators.spread import spread_join

# --- column expressions --------------------------------------------------------


def time_decay(days: Column) -> Column:
    """Share of full ageing after ``days``: 1 - exp(-days / 180)."""
    return 1.0 - F.exp(-days.cast("double") / C.DECAY_DAYS)


def semantic_similarity(belief: Column, truth: Column) -> Column:
    """Number ratio where both texts hold numbers and the truth is positive, else token overlap."""
    believed, true = extract_number(belief), extract_number(truth)
    numeric = believed.isNotNull() & true.isNotNull() & (true > 0)
    return F.when(
        numeric, F.round(F.least(believed, true) / F.greatest(believed, true), 4)
    ).otherwise(F.round(text.token_jaccard(belief, truth), 4))


def classify_level(similarity: Column, fresh: Column, stale: Column) -> Column:
    """FRESH, STALE or CRITICAL by the domain's similarity limits."""
    return (
        F.when(similarity >= F.coalesce(fresh, F.lit(C.DEFAULT_FRESH)), F.lit("FRESH"))
        .when(similarity >= F.coalesce(stale, F.lit(C.DEFAULT_STALE)), F.lit("STALE"))
        .otherwise(F.lit("CRITICAL"))
    )


def score_band(score: Column) -> Column:
    """Band of the staleness score itself: below 0.15 FRESH, below 0.40 STALE."""
    return (
        F.when(score < C.BAND_FRESH, F.lit("FRESH")).when(score < C.BAND_STALE, F.lit("STALE")).otherwise(F.lit("CRITICAL"))
    )


def age_band(days: Column) -> Column:
    """Band of the age in days; the limits belong to the younger band."""
    return (
        F.when(days <= C.AGE_FRESH_DAYS, F.lit("fresh"))
        .when(days <= C.AGE_STALE_DAYS, F.lit("stale"))
        .when(days <= C.AGE_CRITICAL_DAYS, F.lit("critical"))
        .otherwise(F.lit("expired"))
    )


def worst_level(critical: Column, stale: Column) -> Column:
    return F.when(critical > 0, F.lit("CRITICAL")).when(stale > 0, F.lit("STALE")).otherwise(F.lit("FRESH"))


# --- scores --------------------------------------------------------------------


def staleness_score(pairs: DataFrame, domains: DataFrame, as_of: datetime | str) -> DataFrame:
    """Score every (domain, entity, model_belief, warehouse_truth, effective_date) row.

    One projection over one join with the domain dimension; other columns pass through.
    """
    limits = domains.select("domain", F.col("fresh").alias("_fresh"), F.col("stale").alias("_stale"))
    belief, truth = F.coalesce("model_belief", F.lit("")), F.coalesce("warehouse_truth", F.lit(""))
    measured = (
        pairs.join(limits, "domain", "left")
        .withColumn("model_belief", belief)
        .withColumn("warehouse_truth", truth)
        .withColumn("_known", (F.col("model_belief") != "") & (F.col("warehouse_truth") != ""))
        .withColumn("_bnum", extract_number(F.col("model_belief")))
        .withColumn("_tnum", extract_number(F.col("warehouse_truth")))
        .withColumn("_sim", semantic_similarity(F.col("model_belief"), F.col("warehouse_truth")))
        .withColumn("_days", clock.days_since(F.col("effective_date"), as_of))
    )
    sim, days = F.col("_sim"), F.col("_days")
    stale = F.round(F.least((1.0 - sim) * (1.0 + C.DECAY_WEIGHT * time_decay(days)), F.lit(1.0)), 4)
    is_known = F.col("_known")
    return measured.select(
        *pairs.columns,
        F.when(is_known, stale).otherwise(F.lit(1.0)).alias("staleness_score"),
        F.when(is_known, classify_level(sim, F.col("_fresh"), F.col("_stale"))).otherwise(F.lit("UNKNOWN")).alias("staleness_level"),
        F.when(is_known, sim).otherwise(F.lit(0.0)).alias("semantic_similarity"),
        F.when(is_known, F.abs(F.col("_bnum") - F.col("_tnum")) < 1.0).alias("numeric_match"),
        F.when(is_known, days).otherwise(F.lit(0)).alias("days_since_update"),
        F.when(is_known, F.round(C.BASE_CONFIDENCE + (1.0 - C.BASE_CONFIDENCE) * sim, 4))
        .otherwise(F.lit(C.UNKNOWN_CONFIDENCE))
        .alias("confidence"),
    )


def belief_pairs(gold: DataFrame, fallback: bool = True) -> DataFrame:
    """Current facts as belief/truth pairs; an empty belief falls back to the truth."""
    belief = F.col("model_belief")
    if fallback:
        missing = belief.isNull() | belief.isin("", "nan")
        belief = F.when(missing, F.col("value")).otherwise(belief)
    return gold_current(gold).select(
        "domain",
        "entity",
        belief.alias("model_belief"),
        F.col("value").alias("warehouse_truth"),
        "effective_date",
        *[c for c in ("staleness_reason",) if c in gold.columns],
    )


def freshness_probe(
    gold: DataFrame,
    domains: DataFrame,
    as_of: datetime | str,
    company: str = "",
    triggered_by: str = "scheduler",
) -> DataFrame:
    """Score all current facts and add the run columns of the schedule log."""
    at = clock.moment(as_of)
    scored = staleness_score(belief_pairs(gold), domains, as_of)
    key = F.concat(F.lit(f"{company}__" if company else ""), F.col("domain"))
    reason = F.col("staleness_reason")
    return scored.select(
        F.concat(key, F.lit("_"), F.translate(F.substring(at.cast("string"), 1, 19), " :", "T-")).alias("run_id"),
        F.lit(company).alias("company_id"),
        key.alias("domain_key"),
        "domain",
        "entity",
        "staleness_level",
        "staleness_score",
        "semantic_similarity",
        "model_belief",
        "warehouse_truth",
        F.when(reason.isNull() | (reason == "nan"), F.lit("")).otherwise(reason).alias("staleness_reason"),
        at.alias("scheduled_at"),
        at.alias("completed_at"),
        F.lit(triggered_by).alias("triggered_by"),
    )


def _level_counts() -> list[Column]:
    return [F.count_if(F.col("staleness_level") == level).alias(f"{level.lower()}_count") for level in C.LEVELS]


def domain_health(scores: DataFrame) -> DataFrame:
    """Level counts, worst level and mean similarity per domain."""
    # The similarity has four digits, so whole ten-thousandths add up exactly in any order.
    units = F.sum(F.round(F.col("semantic_similarity") * 10_000).cast("bigint"))
    grouped = scores.groupBy("domain").agg(*_level_counts(), units.alias("_units"), F.count("*").alias("entities"))
    return grouped.select(
        "domain",
        worst_level(F.col("critical_count"), F.col("stale_count")).alias("health"),
        *[f"{level.lower()}_count" for level in C.LEVELS],
        F.round(F.col("_units") / F.col("entities") / 10_000.0, 4).alias("avg_similarity"),
    )


def level_counts(scores: DataFrame) -> DataFrame:
    """Rows per staleness level."""
    return scores.groupBy("staleness_level").agg(F.count("*").alias("entities"))


def drift_diff(scores: DataFrame) -> DataFrame:
    """Belief and truth side by side; they drift when the trimmed texts differ."""
    return scores.select(
        "domain",
        "entity",
        "model_belief",
        "warehouse_truth",
        "staleness_level",
        "semantic_similarity",
        "days_since_update",
        (text.stripped(F.col("model_belief")) != text.stripped(F.col("warehouse_truth"))).alias("is_drift"),
    )


def staleness_hint(scores: DataFrame) -> DataFrame:
    """Advice per level."""
    level = F.col("staleness_level")
    return scores.withColumn(
        "remediation_hint",
        F.when(level == "STALE", F.lit("Update RAG context with Gold value"))
        .when(level == "CRITICAL", F.lit("Inject verified context immediately"))
        .otherwise(F.lit("No action required")),
    )


def staleness_event(scores: DataFrame, as_of: datetime | str) -> DataFrame:
    """One STALENESS_DETECTED event per score."""
    payload = F.to_json(
        F.struct(
            F.col("staleness_level").alias("level"),
            F.col("semantic_similarity").alias("sim"),
            F.col("days_since_update"),
        )
    )
    critical = F.col("staleness_level") == "CRITICAL"
    return scores.select(
        F.md5(F.concat_ws("|", F.lit("STALENESS_DETECTED"), "domain", "entity", clock.moment(as_of).cast("string"))).alias("event_id"),
        clock.moment(as_of).alias("event_ts"),
        F.lit("DKSM").alias("source_module"),
        F.lit("STALENESS_DETECTED").alias("event_type"),
        "domain",
        "entity",
        payload.alias("payload"),
        F.when(critical, F.lit("CRITICAL")).otherwise(F.lit("INFO")).alias("severity"),
        critical.alias("requires_approval"),
    )


# --- stored answers and probes ---------------------------------------------------

DIAGNOSES = {  # fixed texts per case; A and B stand for the two providers
    "unavailable": "Both providers unavailable — cannot determine staleness.",
    "both_match": "Both models agree with Gold. No staleness detected.",
    "same_wrong": "Both models agree on the same wrong value — high confidence the knowledge index is universally stale.",
    "only_a": "A matches Gold but B does not — issue may be model-specific (B).",
    "only_b": "B matches Gold but A does not — issue may be model-specific (A).",
    "neither": "Models disagree with each other and neither matches Gold — staleness confirmed but cause is inconclusive.",
}


def cross_model_agreement(answers: DataFrame) -> DataFrame:
    """Compare two stored answers with each other and with the gold value."""

    def usable(answer: str) -> Column:
        value = F.coalesce(answer, F.lit(C.UNAVAILABLE))
        return ~F.contains(value, F.lit(C.UNAVAILABLE)) & ~F.contains(F.lower(value), F.lit(C.ANSWER_ERROR))

    flagged = answers.withColumn("_ok_a", usable("answer_a")).withColumn("_ok_b", usable("answer_b"))
    compared = flagged.select(
        *answers.columns,
        "_ok_a",
        "_ok_b",
        (F.col("_ok_a") & text.values_match(F.col("answer_a"), F.col("gold_value"))).alias("a_matches"),
        (F.col("_ok_b") & text.values_match(F.col("answer_b"), F.col("gold_value"))).alias("b_matches"),
        (F.col("_ok_a") & F.col("_ok_b") & text.values_match(F.col("answer_a"), F.col("answer_b"))).alias("agreement"),
    )
    both = F.col("a_matches") & F.col("b_matches")
    case = (
        F.when(~F.col("_ok_a") & ~F.col("_ok_b"), F.lit("unavailable"))
        .when(both, F.lit("both_match"))
        .when(F.col("agreement"), F.lit("same_wrong"))
        .when(F.col("a_matches"), F.lit("only_a"))
        .when(F.col("b_matches"), F.lit("only_b"))
        .otherwise(F.lit("neither"))
    )
    wording = F.create_map(*[F.lit(x) for pair in DIAGNOSES.items() for x in pair])
    return (
        compared.withColumn("both_match_gold", both)
        .withColumn("diagnosis", case)
        .withColumn("diagnosis_text", wording[F.col("diagnosis")])
        .drop("_ok_a", "_ok_b")
    )


def latest_valid_probe(probes: DataFrame, as_of: datetime | str, ttl_hours: int = C.PROBE_TTL_HOURS) -> DataFrame:
    """Newest stored probe per domain and entity (any case) that is younger than the time-to-live."""
    at = clock.moment(as_of)
    young = probes.filter((F.col("probe_ts") > at - clock.hours(ttl_hours)) & (F.col("probe_ts") <= at))
    row = F.struct(*[F.col(c) for c in probes.columns if c not in ("domain",)])
    return (
        young.groupBy("domain", F.lower("entity").alias("entity_key"))
        .agg(F.max_by(row, F.struct("probe_ts", "probe_id")).alias("_p"))
        .select("domain", "entity_key", "_p.*")
    )


def domain_health_rollup(
    gold: DataFrame,
    probes: DataFrame,
    domains: DataFrame,
    as_of: datetime | str,
    window_days: int = 30,
    ttl_hours: int = C.PROBE_TTL_HOURS,
) -> DataFrame:
    """Health, risk and last probe per domain; facts without a valid probe count as believed."""
    from veralytics.operators.risk import simulate_entity

    valid = latest_valid_probe(probes, as_of, ttl_hours).select(
        "domain", "entity_key", F.col("model_belief").alias("_belief"), F.col("probe_ts").alias("_probed")
    )
    pairs = (
        gold_current(gold)
        .withColumn("entity_key", F.lower("entity"))
        .join(valid, ["domain", "entity_key"], "left")
        .select(
            "domain",
            "entity",
            F.coalesce("_belief", "value").alias("model_belief"),
            F.col("value").alias("warehouse_truth"),
            "effective_date",
            "_probed",
        )
    )
    risk = simulate_entity(staleness_score(pairs, domains, as_of), domains, window_days)
    grouped = risk.groupBy("domain").agg(
        *_level_counts(),
        F.sum("decisions_at_risk").alias("decisions_at_risk"),
        F.sum("estimated_exposure_usd").alias("estimated_exposure_usd"),
        F.max("_probed").alias("last_probed"),
    )
    health = worst_level(F.col("critical_count"), F.col("stale_count"))
    everything = W.partitionBy()
    return (
        grouped.withColumn("health", health)
        .withColumn(
            "overall_health",
            worst_level(
                F.count_if(F.col("health") == "CRITICAL").over(everything), F.count_if(F.col("health") == "STALE").over(everything)
            ),
        )
        .withColumn("total_decisions_at_risk", F.sum("decisions_at_risk").over(everything))
    )


# --- graded attempts ---------------------------------------------------------------


def crag_resolve(attempts: DataFrame, context: DataFrame, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Settle each probe from its graded attempts in order.

    A CORRECT answer ends the walk, an AMBIGUOUS one is retried while retries are left,
    anything else falls back to the best context row. ``retries_used`` counts the retries;
    ``retries_reported`` is what the outer call of a nested retry reports: 1 after any retry.
    """
    # The walk never goes past max_retries, so the rank filter (a per-task limit before the
    # shuffle) is exact and keeps a probe with very many attempts small.
    numbered = (
        attempts.withColumn("_no", F.row_number().over(W.partitionBy("probe_id").orderBy("attempt")))
        .filter(F.col("_no") <= max_retries + 1)
        .withColumn("_step", F.col("_no") - 1)
        .drop("_no")
    )
    ends = (F.col("grade") != "AMBIGUOUS") | (F.col("_step") >= max_retries)
    walked = numbered.withColumn("_end", F.min(F.when(ends, F.col("_step"))).over(W.partitionBy("probe_id")))
    last = F.max("_step").over(W.partitionBy("probe_id"))
    walked = walked.withColumn("_end", F.coalesce("_end", last)).filter(F.col("_step") <= F.col("_end"))
    final = F.struct("_step", "grade", "extracted_value", "confidence")
    settled = walked.groupBy("probe_id").agg(
        F.max_by(final, "_step").alias("_f"), F.sum("cost_micros").alias("cost_micros")
    )
    best = context.groupBy("probe_id").agg(
        F.min_by("current_value", F.struct(-F.col("similarity_score"), F.col("entity"))).alias("_fallback")
    )
    fallback = F.col("_f.grade") != "CORRECT"
    return settled.join(best, "probe_id", "left").select(
        "probe_id",
        F.col("_f.grade").alias("crag_grade"),
        F.col("_f.confidence").alias("crag_confidence"),
        F.when(fallback, F.col("_fallback")).otherwise(F.col("_f.extracted_value")).alias("extracted_value"),
        F.col("_f._step").alias("retries_used"),
        F.least(F.col("_f._step"), F.lit(1)).alias("retries_reported"),
        fallback.alias("crag_fallback"),
        F.when(fallback, F.lit("vector_store")).otherwise(F.lit("")).alias("fallback_source"),
        "cost_micros",
    )


def crag_log(results: DataFrame, as_of: datetime | str) -> DataFrame:
    """Audit rows of settled probes."""
    return results.select(
        clock.moment(as_of).alias("timestamp"),
        F.col("question") if "question" in results.columns else F.col("probe_id").cast("string").alias("question"),
        F.col("crag_grade").alias("grade"),
        F.col("crag_confidence").alias("confidence"),
        F.col("retries_reported").alias("retries_used"),
        F.coalesce("extracted_value", F.lit("")).alias("final_extracted_value"),
        F.round(F.col("cost_micros") / 1e6, 6).alias("cost_usd"),
    )


def probe_cost(usage: DataFrame, rates: DataFrame, default_rate: float = C.COST_DEFAULT_PER_1K) -> DataFrame:
    """Cost of each call: tokens in and out per thousand times the model's rate."""
    rate = F.coalesce("rate_per_1k", F.lit(default_rate))
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return usage.join(rates, "model", "left").withColumn("cost_usd", F.round(tokens / 1000 * rate, 6)).drop("rate_per_1k")


def probe_plan(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions to ask per requested domain; a domain without configuration is rejected.

    ``questions`` holds (domain, questions ARRAY) in asking order.
    """
    joined = requests.join(questions, "domain", "left")
    listed = joined.select(
        *requests.columns,
        F.posexplode_outer("questions").alias("pos", "question"),
        F.when(F.col("questions").isNull(), F.concat(F.lit("Unknown domain: "), "domain")).alias("error"),
    )
    return listed


def probe_question(gold: DataFrame) -> DataFrame:
    """The question that asks for an entity's value."""
    domain, entity = F.col("domain"), F.col("entity")
    wording = (
        F.when(
            domain == "customer_segments",
            F.concat(
                F.lit("What is the minimum annual revenue threshold in USD for a customer to be classified as "),
                entity,
                F.lit(" tier?"),
            ),
        )
        .when(domain == "product_catalog", F.concat(F.lit("What is the current price in USD of "), entity, F.lit("?")))
        .when(domain == "risk_thresholds", F.concat(F.lit("What is the exact threshold value for "), entity, F.lit("?")))
        .otherwise(F.concat(F.lit("What is the current value for "), entity, F.lit(" in "), domain, F.lit("?")))
    )
    return gold.withColumn("question", wording)


def reference_mention(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Is the fact's value mentioned in the reference text of its entity?

    ``facts`` (entity, value), ``corpus`` (entity, reference_text, reference_url).
    """
    joined = facts.join(corpus, "entity", "left")
    raw, bare = text.stripped(F.col("value")), text.strip_units(F.col("value"))
    body = F.lower("reference_text")
    said = ((raw != "") & F.contains(body, F.lower(raw))) | ((bare != "") & F.contains(body, F.lower(bare)))
    available = F.col("reference_text").isNotNull()
    return joined.select(
        *facts.columns,
        F.when(available, F.substring("reference_text", 1, C.SNIPPET_CHARS)).otherwise(F.lit("")).alias("summary"),
        F.coalesce(said, F.lit(False)).alias("mentions_value"),
        F.col("reference_url").alias("url"),
        available.alias("available"),
    )


# --- plans and reports ---------------------------------------------------------------

PLAN_TEMPLATES = [  # level, action, effort, hours, priority, text with %1$s entity, %2$s domain, %3$s value, %4$s date
    ("CRITICAL", "IMMEDIATE: Inject RAG system-prompt patch before any model inference", "LOW", 2, 1,
     "Since %4$s the verified value of %2$s / %1$s is %3$s. Use only this value."),
    ("STALE", "SOON: Add to next fine-tuning batch or RAG retrieval augmentation", "MEDIUM", 8, 2,
     "As of %4$s, the current %1$s in %2$s is %3$s."),
    ("MONITOR", "MONITOR: Set up automated staleness alerts", "LOW", 1, 3,
     "Alert when %2$s / %1$s scores above 0.7; last known value %3$s of %4$s."),
]


def _explanation(plan_key: Column) -> Column:
    """Why the plan is as it is, with the score and, where it is urgent, both values."""
    score = F.format_number(F.col("staleness_score"), 2)
    belief, truth = (F.coalesce(F.col(c), F.lit("")) for c in ("model_belief", "warehouse_truth"))
    critical = F.format_string(
        "%s is critical at a score of %s: the model holds '%s', the gold layer '%s'. Put the gold value into the prompt now and train on it within 30 days.",
        F.col("entity"), score, belief, truth,
    )
    stale = F.format_string(
        "%s drifts at a score of %s. Add a corrected example to the next training run, or fetch the gold value before each answer.", F.col("entity"), score
    )
    calm = F.format_string("%s needs no action at a score of %s. Keep an alert on it.", F.col("entity"), score)
    return F.when(plan_key == "CRITICAL", critical).when(plan_key == "STALE", stale).otherwise(calm)


def remediation_plan(scores: DataFrame) -> DataFrame:
    """Action, effort, hours, priority, explanation and ready-to-use text per score."""
    level = F.col("staleness_level")
    plan_key = F.when(level.isin("CRITICAL", "STALE"), level).otherwise(F.lit("MONITOR"))
    templates = fixed(
        scores.sparkSession,
        PLAN_TEMPLATES,
        "plan_key string, primary_action string, effort_level string, estimated_hours int, priority int, _text string",
    )
    day = F.coalesce(F.col("effective_date").cast("string"), F.lit(""))
    snippet = F.when(
        F.col("plan_key") == "CRITICAL",
        F.format_string(PLAN_TEMPLATES[0][5], "entity", "domain", "warehouse_truth", day),
    ).when(
        F.col("plan_key") == "STALE",
        F.format_string(PLAN_TEMPLATES[1][5], "entity", "domain", "warehouse_truth", day),
    ).otherwise(F.format_string(PLAN_TEMPLATES[2][5], "entity", "domain", "warehouse_truth", day))
    return (
        scores.withColumn("plan_key", plan_key)
        .join(templates, "plan_key")
        .withColumn("snippet", snippet)
        .withColumn("explanation", _explanation(F.col("plan_key")))
        .withColumn("entity_slug", F.regexp_replace(F.lower("entity"), "[ -]", "_"))
        .drop("plan_key", "_text")
    )


def domain_report(scores: DataFrame, exposure: DataFrame) -> DataFrame:
    """Counts and exposure per domain."""
    counted = scores.groupBy("domain").agg(F.count("*").alias("entity_count"), *_level_counts())
    return counted.join(exposure.select("domain", "exposure_usd"), "domain", "left").withColumn(
        "exposure_usd", F.coalesce("exposure_usd", F.lit(0.0))
    )


def domain_report_plans(scores: DataFrame, exposure: DataFrame) -> DataFrame:
    """The report as rows: every plan next to its domain's figures, in plan order.

    Kept as rows, not as one nested list per domain, so that no domain has to fit into one
    task; the order is a range-partitioned sort.
    """
    plans = spread_join(remediation_plan(scores), domain_report(scores, exposure), ["domain"], ["entity"])
    return plans.orderBy("domain", "priority", "entity")


def validate_requests(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """Mark requests with the reason they are rejected and clamp top_k to 1..10."""
    known = domains.select("domain", F.lit(True).alias("_known")).distinct()
    joined = requests.join(known, "domain", "left")
    entity, asked = F.col("entity"), F.col("query")
    reason = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown domain '"), "domain", F.lit("'")))
        .when(text.blank(entity), F.lit("Entity name cannot be empty"))
        .when(
            F.length(entity) > C.MAX_ENTITY_CHARS,
            F.concat(F.lit("Entity name too long ("), F.length(entity).cast("string"), F.lit(f" chars, max {C.MAX_ENTITY_CHARS})")),
        )
        .when(text.blank(asked), F.lit("Search query cannot be empty"))
    )
    return joined.select(
        *[c for c in requests.columns if c != "top_k"],
        F.least(F.greatest(F.col("top_k"), F.lit(C.MIN_TOP_K)), F.lit(C.MAX_TOP_K)).alias("top_k"),
        reason.alias("error"),
        reason.isNull().alias("valid"),
    )


def entity_check(
    requests: DataFrame, gold: DataFrame, probes: DataFrame, domains: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Check many entities at once: validate, look up, take the valid probe or the truth, score, price, plan."""
    from veralytics.operators.risk import simulate_entity

    known = domains.select("domain", F.lit(True).alias("_known")).distinct()
    entity = F.col("entity")
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown domain '"), "domain", F.lit("'")))
        .when(text.blank(entity), F.lit("Entity name cannot be empty"))
        .when(F.length(entity) > C.MAX_ENTITY_CHARS, F.lit("Entity name too long"))
    )
    checked = requests.select("request_id", "domain", "entity").join(known, "domain", "left").withColumn("error", error).drop("_known")
    good = checked.filter(F.col("error").isNull()).drop("error")
    found = entity_lookup(gold, good).select(
        "request_id", "domain", F.col("entity").alias("requested"), "match_type",
        F.col("gold_entity"), "value", "effective_date",
    )
    valid = latest_valid_probe(probes, as_of).select("domain", F.col("entity_key"), F.col("model_belief").alias("_belief"))
    pairs = (
        found.filter(F.col("match_type") != "none")
        .withColumn("entity_key", F.lower("gold_entity"))
        .join(valid, ["domain", "entity_key"], "left")
        .select(
            "request_id", "domain", F.col("requested").alias("entity"),
            F.coalesce("_belief", "value").alias("model_belief"), F.col("value").alias("warehouse_truth"), "effective_date",
        )
    )
    scored = remediation_plan(simulate_entity(staleness_score(pairs, domains, as_of), domains))
    columns = [
        "request_id", "domain", "entity", "staleness_level", "model_belief", "warehouse_truth",
        "semantic_similarity", "days_since_update", "decisions_at_risk", "primary_action", "confidence",
    ]

    def unknown(rows: DataFrame, truth: Column, action: Column) -> DataFrame:
        return rows.select(
            "request_id", "domain", "entity",
            F.lit("UNKNOWN").alias("staleness_level"), F.lit("").alias("model_belief"), truth.alias("warehouse_truth"),
            F.lit(0.0).alias("semantic_similarity"), F.lit(0).alias("days_since_update"),
            F.lit(0).cast("bigint").alias("decisions_at_risk"), action.alias("primary_action"), F.lit(0.0).alias("confidence"),
        )

    rejected = unknown(checked.filter(F.col("error").isNotNull()), F.lit(""), F.col("error"))
    missing = unknown(
        found.filter(F.col("match_type") == "none").withColumnRenamed("requested", "entity"),
        F.concat(F.lit("Entity '"), "entity", F.lit("' not found in Gold layer")),
        F.lit("Verify entity name against Gold layer"),
    )
    return scored.select(*columns).unionByName(rejected).unionByName(missing)


def executive_summary(exposures: DataFrame, as_of: datetime | str) -> DataFrame:
    """The ordered lines of the plain-text summary, as (section, sort_key, line) rows."""
    from veralytics.operators.risk import domain_breakdown, portfolio_risk

    totals = portfolio_risk(exposures)
    at = F.concat(F.substring(clock.moment(as_of).cast("string"), 1, 16), F.lit(" UTC"))
    head = totals.select(
        F.posexplode(
            F.array(
                F.lit("=== Domain Knowledge Staleness Report ==="),
                F.concat(F.lit("Generated: "), at),
                F.lit(""),
                F.concat(F.lit("Portfolio Risk Grade: "), "risk_grade"),
                F.concat(F.lit("Total Estimated Exposure: $"), text.thousands(F.col("total_exposure_usd"))),
                F.concat(F.lit("Decisions at Risk (30d): "), text.thousands(F.col("total_decisions_at_risk"))),
                F.lit(""),
                F.lit("Domain Breakdown:"),
            )
        ).alias("pos", "line")
    ).select(F.lit(1).alias("section"), F.format_string("%04d", "pos").alias("sort_key"), "line")
    middle = domain_breakdown(exposures).select(
        F.lit(2).alias("section"),
        F.col("domain").alias("sort_key"),
        F.concat(F.lit("  "), "domain", F.lit(": $"), text.thousands(F.col("exposure_usd"))).alias("line"),
    )
    critical = exposures.filter(F.col("staleness_level") == "CRITICAL")
    title = totals.filter(F.col("critical_entities") > 0).select(
        F.posexplode(F.array(F.lit(""), F.lit("CRITICAL Entities Requiring Immediate Action:"))).alias("pos", "line")
    ).select(F.lit(3).alias("section"), F.format_string("%04d", "pos").alias("sort_key"), "line")
    tail = critical.select(
        F.lit(4).alias("section"),
        F.concat("domain", F.lit("/"), "entity").alias("sort_key"),
        F.concat(F.lit("  ⚠  "), "entity").alias("line"),
    )
    return head.unionByName(middle).unionByName(title).unionByName(tail)
