"""Queries over staleness scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics import dims
from veralytics.functions import clock, text
from veralytics.functions.numbers import extract_number
from veralytics.operators import medallion as M
from veralytics.operators import risk as R
from veralytics.operators import scoring as S
from veralytics.plans.oracle_parts import jaccard, number, risk, scores, words
from veralytics.plans.registry import query
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables


def raw_scores(t: Tables) -> DataFrame:
    return S.staleness_score(S.belief_pairs(t.gold, fallback=False), t.domains, AS_OF)


def probed(t: Tables) -> DataFrame:
    return S.staleness_score(S.belief_pairs(t.gold), t.domains, AS_OF)


@query(
    "extract_number",
    f"SELECT page_id, {number('url')} AS url_number FROM {{pages}}",
)
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", extract_number(F.col("url")).alias("url_number"))


@query(
    "days_since",
    f"""SELECT event_id, CAST(floor(epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) / 86400000000.0 - epoch_us(ts) / 86400000000.0) AS INT) AS days
    FROM {{events}}""",
)
def _(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id", clock.days_since(F.col("ts"), clock.moment(AS_OF) - clock.days(10)).alias("days")
    )


@query(
    "time_decay",
    f"""SELECT domain, entity, version, round(1 - exp(-CAST(date_diff('day', effective_date, DATE '2024-01-31') AS DOUBLE) / 180), 9) AS decay
    FROM {{fx_gold}}""",
)
def _(t: Tables) -> DataFrame:
    days = clock.days_since(F.col("effective_date"), AS_OF)
    return t.gold.select("domain", "entity", "version", F.round(S.time_decay(days), 9).alias("decay"))


@query(
    "token_jaccard",
    f"""SELECT conv_id, turn, round({jaccard('a', 'b')}, 6) AS overlap
    FROM (SELECT conv_id, turn, {words('text')} AS a, {words('prev')} AS b
      FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {{conversations}}) WHERE prev IS NOT NULL)""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    turns = t["conversations"].withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return turns.filter(F.col("prev").isNotNull()).select(
        "conv_id", "turn", F.round(text.token_jaccard(F.col("text"), F.col("prev")), 6).alias("overlap")
    )


@query("semantic_similarity", "SELECT domain, entity, semantic_similarity AS similarity FROM {ox_probed}")
def _(t: Tables) -> DataFrame:
    pairs = S.belief_pairs(t.gold)
    return pairs.select(
        "domain", "entity", S.semantic_similarity(F.col("model_belief"), F.col("warehouse_truth")).alias("similarity")
    )


@query(
    "classify_level",
    """SELECT n AS event, domain, CASE WHEN s >= fresh THEN 'FRESH' WHEN s >= stale THEN 'STALE' ELSE 'CRITICAL' END AS level
    FROM (SELECT n, domain, CAST(cents % 101 AS DOUBLE) / 100 AS s FROM {fx_bus}) JOIN {fx_domains} USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    sims = t["fx_bus"].select(F.col("n").alias("event"), "domain", (F.col("cents") % 101 / F.lit(100.0)).alias("s"))
    return sims.join(t.domains, "domain").select(
        "event", "domain", S.classify_level(F.col("s"), F.col("fresh"), F.col("stale")).alias("level")
    )


_SCORE_COLUMNS = [
    "domain", "entity", "model_belief", "warehouse_truth", "staleness_score", "staleness_level",
    "semantic_similarity", "numeric_match", "days_since_update", "confidence",
]


@query("staleness_score", f"SELECT {', '.join(_SCORE_COLUMNS)} FROM {{ox_scores}}")
def _(t: Tables) -> DataFrame:
    return raw_scores(t).select(*_SCORE_COLUMNS)


@query(
    "score_band",
    """SELECT domain, entity, CASE WHEN staleness_score < 0.15 THEN 'FRESH' WHEN staleness_score < 0.40 THEN 'STALE' ELSE 'CRITICAL' END AS band
    FROM {ox_scores}""",
)
def _(t: Tables) -> DataFrame:
    return raw_scores(t).select("domain", "entity", S.score_band(F.col("staleness_score")).alias("band"))


ORACLE_PARTS["ox_health"] = """
SELECT domain, CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN stale_count > 0 THEN 'STALE' ELSE 'FRESH' END AS health,
  fresh_count, stale_count, critical_count, unknown_count, avg_similarity
FROM (SELECT domain, count(*) FILTER (staleness_level = 'FRESH') AS fresh_count,
    count(*) FILTER (staleness_level = 'STALE') AS stale_count, count(*) FILTER (staleness_level = 'CRITICAL') AS critical_count,
    count(*) FILTER (staleness_level = 'UNKNOWN') AS unknown_count,
    round(CAST(sum(CAST(round(semantic_similarity * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000, 4) AS avg_similarity
  FROM {ox_scores} GROUP BY domain)
"""


@query("domain_health", "SELECT * FROM {ox_health}")
def _(t: Tables) -> DataFrame:
    return S.domain_health(raw_scores(t))


@query("level_counts", "SELECT staleness_level, count(*) AS entities FROM {ox_scores} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.level_counts(raw_scores(t))


@query(
    "freshness_probe",
    f"""SELECT 'acme__' || domain || '_2024-01-31T21-00-00' AS run_id, 'acme' AS company_id, 'acme__' || domain AS domain_key, entity,
      staleness_level, semantic_similarity, staleness_score, model_belief, warehouse_truth,
      CASE WHEN staleness_reason IS NULL OR staleness_reason = 'nan' THEN '' ELSE staleness_reason END AS staleness_reason,
      TIMESTAMP '{AS_OF}' AS completed_at, 'manual' AS triggered_by
    FROM {{ox_probed}}""",
)
def _(t: Tables) -> DataFrame:
    return S.freshness_probe(t.gold, t.domains, AS_OF, company="acme", triggered_by="manual").drop("domain", "scheduled_at")


@query(
    "drift_diff",
    """SELECT domain, entity, model_belief, warehouse_truth, staleness_level, semantic_similarity, days_since_update,
      trim(model_belief) <> trim(warehouse_truth) AS is_drift FROM {ox_probed}""",
)
def _(t: Tables) -> DataFrame:
    return S.drift_diff(probed(t))


@query(
    "staleness_hint",
    """SELECT domain, entity, staleness_level, CASE staleness_level WHEN 'STALE' THEN 'Update RAG context with Gold value'
      WHEN 'CRITICAL' THEN 'Inject verified context immediately' ELSE 'No action required' END AS remediation_hint FROM {ox_scores}""",
)
def _(t: Tables) -> DataFrame:
    return S.staleness_hint(raw_scores(t)).select("domain", "entity", "staleness_level", "remediation_hint")


@query(
    "staleness_event",
    f"""SELECT TIMESTAMP '{AS_OF}' AS event_ts, 'DKSM' AS source_module, 'STALENESS_DETECTED' AS event_type, domain, entity,
      staleness_level AS level, days_since_update, CASE WHEN staleness_level = 'CRITICAL' THEN 'CRITICAL' ELSE 'INFO' END AS severity,
      staleness_level = 'CRITICAL' AS requires_approval FROM {{ox_scores}}""",
)
def _(t: Tables) -> DataFrame:
    events = S.staleness_event(raw_scores(t), AS_OF)
    body = F.from_json("payload", "level string, sim double, days_since_update int")
    return events.withColumn("_p", body).select(
        "event_ts", "source_module", "event_type", "domain", "entity", F.col("_p.level").alias("level"),
        F.col("_p.days_since_update").alias("days_since_update"), "severity", "requires_approval",
    )


def _same(a: str, b: str) -> str:
    def norm(x: str) -> str:
        return f"regexp_replace(trim(lower({x})), '[.,;:]+$', '')"

    return f"{norm(a)} = {norm(b)}"


@query("values_match", f"SELECT k, {_same('answer_a', 'gold_value')} AS same FROM {{fx_answers}}")
def _(t: Tables) -> DataFrame:
    return t["fx_answers"].select("k", text.values_match(F.col("answer_a"), F.col("gold_value")).alias("same"))


@query(
    "cross_model_agreement",
    f"""
    SELECT k, a_ok AND a_eq AS a_matches, b_ok AND b_eq AS b_matches, a_ok AND b_ok AND ab AS agreement,
      a_ok AND a_eq AND b_ok AND b_eq AS both_match_gold,
      CASE WHEN NOT a_ok AND NOT b_ok THEN 'unavailable' WHEN a_ok AND a_eq AND b_ok AND b_eq THEN 'both_match'
        WHEN a_ok AND b_ok AND ab THEN 'same_wrong' WHEN a_ok AND a_eq THEN 'only_a' WHEN b_ok AND b_eq THEN 'only_b'
        ELSE 'neither' END AS diagnosis
    FROM (SELECT k, NOT contains(answer_a, '[unavailable]') AS a_ok, NOT contains(answer_b, '[unavailable]') AS b_ok,
      {_same('answer_a', 'gold_value')} AS a_eq, {_same('answer_b', 'gold_value')} AS b_eq, {_same('answer_a', 'answer_b')} AS ab
      FROM {{fx_answers}})
    """,
)
def _(t: Tables) -> DataFrame:
    return S.cross_model_agreement(t["fx_answers"]).select(
        "k", "a_matches", "b_matches", "agreement", "both_match_gold", "diagnosis"
    )


# Probes run to the end of the stored events, so the 24 h rule needs a clock near them.
PROBE_AS_OF = "2024-01-05 12:00:00"
ORACLE_PARTS["ox_valid"] = f"""
SELECT domain, lower(entity) AS entity_key, entity, probe_ts, model_belief, probe_id FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, lower(entity) ORDER BY probe_ts DESC, probe_id DESC) AS rn FROM {{fx_probes}}
  WHERE probe_ts > TIMESTAMP '{PROBE_AS_OF}' - INTERVAL 24 HOUR AND probe_ts <= TIMESTAMP '{PROBE_AS_OF}') WHERE rn = 1
"""


@query("latest_valid_probe", "SELECT domain, entity_key, entity, probe_ts, model_belief, probe_id FROM {ox_valid}")
def _(t: Tables) -> DataFrame:
    return S.latest_valid_probe(t["fx_probes"], PROBE_AS_OF)


ORACLE_PARTS["ox_rollup_pairs"] = """
SELECT g.domain, g.entity, coalesce(v.model_belief, g.value) AS model_belief, g.value AS warehouse_truth, g.effective_date, v.probe_ts
FROM {ox_current} g LEFT JOIN {ox_valid} v ON v.domain = g.domain AND v.entity_key = lower(g.entity)
"""
ORACLE_PARTS["ox_rollup"] = scores("{ox_rollup_pairs}", PROBE_AS_OF)
ORACLE_PARTS["ox_rollup_risk"] = risk("{ox_rollup}")


@query(
    "domain_health_rollup",
    """
    SELECT *, CASE WHEN bool_or(health = 'CRITICAL') OVER () THEN 'CRITICAL' WHEN bool_or(health = 'STALE') OVER () THEN 'STALE' ELSE 'FRESH' END AS overall_health,
      CAST(sum(decisions_at_risk) OVER () AS BIGINT) AS total_decisions_at_risk
    FROM (SELECT *, CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN stale_count > 0 THEN 'STALE' ELSE 'FRESH' END AS health FROM (
      SELECT domain, count(*) FILTER (staleness_level = 'FRESH') AS fresh_count, count(*) FILTER (staleness_level = 'STALE') AS stale_count,
        count(*) FILTER (staleness_level = 'CRITICAL') AS critical_count, count(*) FILTER (staleness_level = 'UNKNOWN') AS unknown_count,
        CAST(sum(decisions_at_risk) AS BIGINT) AS decisions_at_risk, sum(estimated_exposure_usd) AS estimated_exposure_usd,
        max(probe_ts) AS last_probed FROM {ox_rollup_risk} GROUP BY domain))
    """,
)
def _(t: Tables) -> DataFrame:
    return S.domain_health_rollup(t.gold, t["fx_probes"], t.domains, PROBE_AS_OF)


ORACLE_PARTS["ox_resolved"] = """
WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY attempt) - 1 AS INT) AS step FROM {fx_attempts}),
e AS (SELECT probe_id, coalesce(min(step) FILTER (grade <> 'AMBIGUOUS' OR step >= 2), max(step)) AS last_step FROM n GROUP BY probe_id),
c AS (SELECT probe_id, current_value, row_number() OVER (PARTITION BY probe_id ORDER BY similarity_score DESC, entity) AS rn FROM {fx_context})
SELECT e.probe_id, n.grade AS crag_grade, n.confidence AS crag_confidence,
  CASE WHEN n.grade = 'CORRECT' THEN n.extracted_value ELSE c.current_value END AS extracted_value,
  e.last_step AS retries_used, least(e.last_step, 1) AS retries_reported, n.grade <> 'CORRECT' AS crag_fallback,
  CASE WHEN n.grade = 'CORRECT' THEN '' ELSE 'vector_store' END AS fallback_source,
  (SELECT CAST(sum(m.cost_micros) AS BIGINT) FROM n m WHERE m.probe_id = e.probe_id AND m.step <= e.last_step) AS cost_micros
FROM e JOIN n ON n.probe_id = e.probe_id AND n.step = e.last_step LEFT JOIN c ON c.probe_id = e.probe_id AND c.rn = 1
"""


@query("crag_resolve", "SELECT * FROM {ox_resolved}")
def _(t: Tables) -> DataFrame:
    return S.crag_resolve(t["fx_attempts"], t["fx_context"])


@query(
    "crag_log",
    f"""SELECT TIMESTAMP '{AS_OF}' AS timestamp, CAST(probe_id AS STRING) AS question, crag_grade AS grade, crag_confidence AS confidence,
      retries_reported AS retries_used, coalesce(extracted_value, '') AS final_extracted_value,
      round(CAST(cost_micros AS DOUBLE) / 1000000, 6) AS cost_usd FROM {{ox_resolved}}""",
)
def _(t: Tables) -> DataFrame:
    return S.crag_log(S.crag_resolve(t["fx_attempts"], t["fx_context"]), AS_OF)


@query(
    "probe_cost",
    """SELECT conv_id, turn, round(CAST(input_tokens + output_tokens AS DOUBLE) / 1000 * CAST(CASE model WHEN 'claude-haiku-4-5-20251001' THEN 0.00025
        WHEN 'claude-opus-4-7' THEN 0.015 ELSE 0.003 END AS DOUBLE), 6) AS cost_usd
    FROM (SELECT conv_id, turn, length(text) AS input_tokens, turn * 10 AS output_tokens,
      CASE conv_id % 4 WHEN 0 THEN 'claude-haiku-4-5-20251001' WHEN 1 THEN 'claude-opus-4-7' WHEN 2 THEN 'claude-sonnet-4-6' ELSE 'other' END AS model
      FROM {conversations})""",
)
def _(t: Tables) -> DataFrame:
    model = (
        F.when(F.col("conv_id") % 4 == 0, "claude-haiku-4-5-20251001")
        .when(F.col("conv_id") % 4 == 1, "claude-opus-4-7")
        .when(F.col("conv_id") % 4 == 2, "claude-sonnet-4-6")
        .otherwise("other")
    )
    usage = t["conversations"].select(
        "conv_id", "turn", model.alias("model"), F.length("text").alias("input_tokens"), (F.col("turn") * 10).alias("output_tokens")
    )
    return S.probe_cost(usage, dims.model_rates(t.spark)).select("conv_id", "turn", "cost_usd")


@query(
    "probe_plan",
    """SELECT r.request_id, r.domain, CAST(q.pos AS INT) AS pos, q.question,
      CASE WHEN q.domain IS NULL THEN 'Unknown domain: ' || r.domain END AS error
    FROM {fx_requests} r LEFT JOIN (SELECT d.domain, text AS question,
      row_number() OVER (PARTITION BY d.domain ORDER BY item_id) - 1 AS pos FROM {benchmark} JOIN {fx_domains} d ON d.domain_id = item_id % 7) q USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    asked = t["benchmark"].join(t.domains, F.col("domain_id") == F.col("item_id") % 7)
    questions = (
        asked.groupBy("domain")
        .agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("_q"))
        .select("domain", F.col("_q.text").alias("questions"))
    )
    return S.probe_plan(t["fx_requests"].select("request_id", "domain"), questions)


@query(
    "probe_question",
    """SELECT domain, entity, CASE domain
      WHEN 'customer_segments' THEN 'What is the minimum annual revenue threshold in USD for a customer to be classified as ' || entity || ' tier?'
      WHEN 'product_catalog' THEN 'What is the current price in USD of ' || entity || '?'
      WHEN 'risk_thresholds' THEN 'What is the exact threshold value for ' || entity || '?'
      ELSE 'What is the current value for ' || entity || ' in ' || domain || '?' END AS question FROM {ox_current}""",
)
def _(t: Tables) -> DataFrame:
    return S.probe_question(M.gold_current(t.gold)).select("domain", "entity", "question")


@query(
    "reference_mention",
    r"""
    WITH f AS (SELECT doc_id AS entity, CASE WHEN doc_id % 2 = 0 THEN '$' ELSE '' END || lang || CASE WHEN doc_id % 3 = 0 THEN '/month' ELSE '' END AS value
      FROM {documents}),
    b AS (SELECT *, CASE WHEN trim(regexp_replace(regexp_replace(trim(value), '^[\$£€¥₹\s]+', ''), '[/\s].*$', '')) <> ''
      THEN trim(regexp_replace(regexp_replace(trim(value), '^[\$£€¥₹\s]+', ''), '[/\s].*$', '')) ELSE trim(value) END AS bare FROM f)
    SELECT entity, value, coalesce(substring(html, 1, 300), '') AS summary,
      coalesce(contains(lower(html), lower(trim(value))) OR contains(lower(html), lower(bare)), false) AS mentions_value,
      url, html IS NOT NULL AS available
    FROM b LEFT JOIN {pages} ON page_id = entity
    """,
)
def _(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    value = F.concat(
        F.when(doc % 2 == 0, "$").otherwise(""), "lang", F.when(doc % 3 == 0, "/month").otherwise("")
    )
    facts = t["documents"].select(doc.alias("entity"), value.alias("value"))
    corpus = t["pages"].select(
        F.col("page_id").alias("entity"), F.col("html").alias("reference_text"), F.col("url").alias("reference_url")
    )
    return S.reference_mention(facts, corpus)


_PLAN = """
SELECT *, CASE staleness_level WHEN 'CRITICAL' THEN 'IMMEDIATE: Inject RAG system-prompt patch before any model inference'
    WHEN 'STALE' THEN 'SOON: Add to next fine-tuning batch or RAG retrieval augmentation' ELSE 'MONITOR: Set up automated staleness alerts' END AS primary_action,
  CASE staleness_level WHEN 'STALE' THEN 'MEDIUM' ELSE 'LOW' END AS effort_level,
  CASE staleness_level WHEN 'CRITICAL' THEN 2 WHEN 'STALE' THEN 8 ELSE 1 END AS estimated_hours,
  CASE staleness_level WHEN 'CRITICAL' THEN 1 WHEN 'STALE' THEN 2 ELSE 3 END AS priority,
  replace(replace(lower(entity), ' ', '_'), '-', '_') AS entity_slug,
  CASE staleness_level
    WHEN 'CRITICAL' THEN 'Since ' || CAST(effective_date AS STRING) || ' the verified value of ' || domain || ' / ' || entity || ' is ' || warehouse_truth || '. Use only this value.'
    WHEN 'STALE' THEN 'As of ' || CAST(effective_date AS STRING) || ', the current ' || entity || ' in ' || domain || ' is ' || warehouse_truth || '.'
    ELSE 'Alert when ' || domain || ' / ' || entity || ' scores above 0.7; last known value ' || warehouse_truth || ' of ' || CAST(effective_date AS STRING) || '.' END AS snippet
FROM {ox_scores}
"""
ORACLE_PARTS["ox_plan"] = _PLAN


@query(
    "remediation_plan",
    """SELECT domain, entity, staleness_level, primary_action, effort_level, estimated_hours, priority, entity_slug, snippet,
      CASE staleness_level WHEN 'CRITICAL' THEN printf('%s is critical at a score of %.2f: the model holds ''%s'', the gold layer ''%s''. ', entity, staleness_score, model_belief, warehouse_truth)
          || 'Put the gold value into the prompt now and train on it within 30 days.'
        WHEN 'STALE' THEN printf('%s drifts at a score of %.2f. ', entity, staleness_score) || 'Add a corrected example to the next training run, or fetch the gold value before each answer.'
        ELSE printf('%s needs no action at a score of %.2f. Keep an alert on it.', entity, staleness_score) END AS explanation FROM {ox_plan}""",
)
def _(t: Tables) -> DataFrame:
    return S.remediation_plan(raw_scores(t)).select(
        "domain", "entity", "staleness_level", "primary_action", "effort_level", "estimated_hours", "priority", "entity_slug", "snippet", "explanation"
    )


@query(
    "domain_report",
    """
    SELECT p.domain, p.entity, p.primary_action, p.priority, c.entity_count, c.critical_count, c.stale_count, c.fresh_count, c.exposure_usd
    FROM {ox_plan} p JOIN (SELECT domain, count(*) AS entity_count, count(*) FILTER (staleness_level = 'CRITICAL') AS critical_count,
      count(*) FILTER (staleness_level = 'STALE') AS stale_count, count(*) FILTER (staleness_level = 'FRESH') AS fresh_count,
      round(sum(estimated_exposure_usd), 2) AS exposure_usd FROM {ox_risk} GROUP BY domain) c USING (domain)
    """,
)
def _(t: Tables) -> DataFrame:
    scored = raw_scores(t)
    exposure = R.domain_breakdown(R.simulate_entity(scored, t.domains))
    return S.domain_report_plans(scored, exposure).select(
        "domain", "entity", "primary_action", "priority", "entity_count", "critical_count", "stale_count", "fresh_count", "exposure_usd"
    )


@query(
    "age_band",
    """SELECT domain, entity, version, CASE WHEN d <= 30 THEN 'fresh' WHEN d <= 90 THEN 'stale' WHEN d <= 180 THEN 'critical' ELSE 'expired' END AS band
    FROM (SELECT *, date_diff('day', effective_date, DATE '2024-01-31') AS d FROM {fx_gold})""",
)
def _(t: Tables) -> DataFrame:
    days = clock.days_since(F.col("effective_date"), AS_OF)
    return t.gold.select("domain", "entity", "version", S.age_band(days).alias("band"))


@query(
    "validate_requests",
    """SELECT request_id, least(greatest(top_k, 1), 10) AS top_k, error, error IS NULL AS valid FROM (
      SELECT request_id, top_k, CASE WHEN d.domain IS NULL THEN 'Unknown domain ''' || r.domain || ''''
        WHEN trim(entity) = '' THEN 'Entity name cannot be empty' WHEN trim(query) = '' THEN 'Search query cannot be empty' END AS error
      FROM {fx_requests} r LEFT JOIN {fx_domains} d USING (domain))""",
)
def _(t: Tables) -> DataFrame:
    return S.validate_requests(t["fx_requests"], t.domains).select("request_id", "top_k", "error", "valid")


ORACLE_PARTS["ox_check_found"] = """
SELECT * FROM (SELECT r.request_id, r.domain, r.entity AS asked, g.entity, g.value, g.effective_date,
    row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN lower(g.entity) = lower(r.entity) THEN 0 ELSE 1 END, g.version DESC, g.entity) AS rn
  FROM {fx_requests} r JOIN {fx_domains} USING (domain) LEFT JOIN {ox_current} g ON g.domain = r.domain AND contains(lower(g.entity), lower(r.entity))
  WHERE trim(r.entity) <> '') WHERE rn = 1
"""
ORACLE_PARTS["ox_check_pairs"] = """
SELECT f.request_id, f.domain, f.asked AS entity, coalesce(v.model_belief, f.value) AS model_belief, f.value AS warehouse_truth, f.effective_date
FROM {ox_check_found} f LEFT JOIN {ox_valid} v ON v.domain = f.domain AND v.entity_key = lower(f.entity) WHERE f.entity IS NOT NULL
"""
ORACLE_PARTS["ox_check_scores"] = scores("{ox_check_pairs}", PROBE_AS_OF)
ORACLE_PARTS["ox_check_risk"] = risk("{ox_check_scores}")


@query(
    "entity_check",
    """
    SELECT request_id, domain, entity, staleness_level, model_belief, warehouse_truth, semantic_similarity, days_since_update,
      decisions_at_risk, CASE staleness_level WHEN 'CRITICAL' THEN 'IMMEDIATE: Inject RAG system-prompt patch before any model inference'
        WHEN 'STALE' THEN 'SOON: Add to next fine-tuning batch or RAG retrieval augmentation' ELSE 'MONITOR: Set up automated staleness alerts' END AS primary_action,
      confidence FROM {ox_check_risk}
    UNION ALL
    SELECT request_id, domain, asked, 'UNKNOWN', '', 'Entity ''' || asked || ''' not found in Gold layer', 0, 0, 0,
      'Verify entity name against Gold layer', 0 FROM {ox_check_found} WHERE entity IS NULL
    UNION ALL
    SELECT request_id, domain, entity, 'UNKNOWN', '', '', 0, 0, 0,
      CASE WHEN d.domain_id IS NULL THEN 'Unknown domain ''' || domain || '''' ELSE 'Entity name cannot be empty' END, 0
    FROM {fx_requests} LEFT JOIN {fx_domains} d USING (domain) WHERE d.domain_id IS NULL OR trim(entity) = ''
    """,
)
def _(t: Tables) -> DataFrame:
    return S.entity_check(t["fx_requests"], t.gold, t["fx_probes"], t.domains, PROBE_AS_OF)


@query(
    "executive_summary",
    f"""
    WITH totals AS (SELECT *, CASE WHEN usd < 100000 THEN 'A' WHEN usd < 500000 THEN 'B' WHEN usd < 1000000 THEN 'C' WHEN usd < 5000000 THEN 'D' ELSE 'F' END AS grade
      FROM (SELECT round(sum(estimated_exposure_usd), 2) AS usd, CAST(sum(decisions_at_risk) AS BIGINT) AS decisions,
        count(*) FILTER (staleness_level = 'CRITICAL') AS criticals FROM {{ox_risk}})),
    head AS (SELECT unnest(range(8)) AS pos, unnest(['=== Domain Knowledge Staleness Report ===', 'Generated: {AS_OF[:16]} UTC', '',
      'Portfolio Risk Grade: ' || grade, 'Total Estimated Exposure: $' || format('{{{{:,}}}}', CAST(round_even(usd, 0) AS BIGINT)),
      'Decisions at Risk (30d): ' || format('{{{{:,}}}}', decisions), '', 'Domain Breakdown:']) AS line FROM totals)
    SELECT 1 AS section, printf('%04d', pos) AS sort_key, line FROM head
    UNION ALL SELECT 2, domain, '  ' || domain || ': $' || format('{{{{:,}}}}', CAST(round_even(round(sum(estimated_exposure_usd), 2), 0) AS BIGINT)) FROM {{ox_risk}} GROUP BY domain
    UNION ALL SELECT 3, '0000', '' FROM totals WHERE criticals > 0
    UNION ALL SELECT 3, '0001', 'CRITICAL Entities Requiring Immediate Action:' FROM totals WHERE criticals > 0
    UNION ALL SELECT 4, domain || '/' || entity, '  ⚠  ' || entity FROM {{ox_risk}} WHERE staleness_level = 'CRITICAL'
    """,
)
def _(t: Tables) -> DataFrame:
    return S.executive_summary(R.simulate_entity(raw_scores(t), t.domains), AS_OF)
