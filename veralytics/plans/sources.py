"""Queries that write the fixtures in the source formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import coverage as V
from veralytics.operators import events as E
from veralytics.operators import feedback as B
from veralytics.operators import schedule as H
from veralytics.operators import scoring as S
from veralytics.plans.registry import query
from veralytics.sources import profiles as P
from veralytics.sources import merge, readers, schemas, sinks
from veralytics.sources.fixtures import AS_OF, Tables


# The seven configured domains with their key and value columns.
COLUMNS = {
    "customer_segments": ("segment_name", "min_annual_revenue_usd"),
    "product_catalog": ("product_name", "unit_price_usd"),
    "risk_thresholds": ("threshold_name", "threshold_value"),
    "drug_formulary": ("drug_name", "tier_copay_usd"),
    "coverage_limits": ("coverage_type", "limit_usd"),
    "carrier_rates": ("route_code", "rate_usd"),
    "coupons": ("coupon_code", "max_savings_usd"),
}


@query(
    "gold_read",
    """SELECT domain, entity, value, CAST(version AS STRING) AS version, is_current, CAST(effective_date AS STRING) AS effective_date,
      nullif(tier, '') AS tier FROM {fx_gold}""",
)
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    for domain, (key, value) in COLUMNS.items():
        rows = t.gold.filter(F.col("domain") == domain).drop("domain").withColumnsRenamed({"entity": key, "value": value})
        rows.write.option("header", True).csv(f"{folder}/{domain}.csv")
    gold = readers.gold_read_all(t.spark, folder, {**COLUMNS, "no_such_domain": ("k", "v")})
    tier = F.when(F.col("attrs")["tier"] != "", F.col("attrs")["tier"])
    return gold.select("domain", "entity", "value", "version", "is_current", "effective_date", tier.alias("tier"))


def _lines(bus: DataFrame) -> DataFrame:
    """Events as log lines: ISO time with offset, payload as an object, and a broken line per hundredth event."""
    stamp = F.concat(F.translate(F.col("event_ts").cast("string"), " ", "T"), F.lit("+00:00"))
    head = F.to_json(
        F.struct("event_id", stamp.alias("timestamp"), "source_module", "event_type", "domain", "entity", "severity", "requires_approval")
    )
    line = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"payload":'), "payload", F.lit("}"))
    whole = bus.withColumn("_head", head).select(line.alias("value"))
    broken = whole.withColumn("value", F.concat(F.lit("{"), F.substring("value", 20, 40)))
    return whole.unionByName(broken)


@query("event_log_read", "SELECT event_id, event_ts, source_module, event_type, domain, entity, payload, severity, requires_approval FROM {fx_bus}")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    _lines(t.bus).write.text(folder)
    return readers.event_log_read(t.spark, folder)


@query(
    "event_log_append",
    "SELECT event_id, event_type, CAST(CAST(event_ts AS DATE) AS STRING) AS event_date FROM {fx_bus}",
)
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    critical = F.col("severity") == "CRITICAL"
    sinks.event_log_append(t.bus.filter(critical), folder)
    sinks.event_log_append(t.bus.filter(~critical), folder)
    stored = t.spark.read.parquet(folder)
    return stored.select("event_id", "event_type", F.col("event_date").cast("string").alias("event_date"))


@query(
    "run_results_ingest",
    """SELECT right('model.shop.' || run_id || '.' || dbt_model, 8) AS run_id, dbt_model, run_timestamp, status, rows_affected, 'dbt-live' AS schema_version
    FROM {fx_runs} WHERE dbt_model <> 'fct_drug_formulary'""",
)
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    uid = F.concat(F.lit("model.shop."), "run_id", F.lit("."), "dbt_model")
    stamp = F.concat(F.translate(F.col("run_timestamp").cast("string"), " ", "T"), F.lit("Z"))
    result = F.struct(
        uid.alias("unique_id"), "status", F.lit(1.5).alias("execution_time"), F.struct("rows_affected").alias("adapter_response"), F.lit("ok").alias("message")
    )
    artifacts = t["fx_runs"].select(F.struct(stamp.alias("generated_at")).alias("metadata"), F.array(result).alias("results"))
    artifacts.write.json(folder)
    models = t.domains.filter(F.col("dbt_model") != "fct_drug_formulary").select("dbt_model")
    return readers.run_results_ingest(t.spark, folder, models, per_line=True).select(
        "run_id", "dbt_model", "run_timestamp", "status", "rows_affected", "schema_version"
    )


@query("decisions_read", "SELECT decided_at, domain, decision_outcome, risk_cents FROM {fx_decisions}")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    rows = t["fx_decisions"].select(
        F.concat(F.col("decided_at").cast("string"), F.lit("+00:00")).alias("timestamp"), "domain", "decision_outcome",
        (F.col("risk_cents") / 100).alias("risk_amount_usd"),
    )
    rows.write.option("header", True).csv(folder)
    return readers.decisions_read(t.spark, folder)


@query(
    "log_sinks",
    f"""SELECT 'schedule' AS log, count(*) AS n FROM {{ox_probed}} UNION ALL SELECT 'approvals', count(*) FROM {{fx_bus}} WHERE event_type = 'APPROVAL_REQUIRED' OR requires_approval OR severity = 'CRITICAL'
    UNION ALL SELECT 'signals', count(*) FROM {{fx_feedback}}""",
)
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    sinks.append_table(S.freshness_probe(t.gold, t.domains, AS_OF), f"{folder}/schedule", schemas.SCHEDULE_LOG)
    sinks.append_table(E.queue_for_approval(t.bus), f"{folder}/approvals", schemas.APPROVAL_QUEUE, ["domain"])
    sinks.append_table(B.capture_signal(t["fx_feedback"]), f"{folder}/signals", schemas.FEEDBACK_LOG, ["domain"])
    out = None
    for name in ("schedule", "approvals", "signals"):
        one = t.spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "finetune_jsonl_sink",
    """SELECT 'What is the current value for ' || entity || '?' AS instruction, 'The current value for ' || entity || ' is ' || correct_value || '. Note: ' || wrong_value || ' is outdated.' AS response
    FROM {ox_routed} WHERE fine_tune""",
)
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch(t.spark)
    sinks.finetune_jsonl_sink(B.finetune_pairs(B.route_correction(t["fx_feedback"])), folder)
    return t.spark.read.schema("instruction string, response string").json(folder)


@query("gap_report_sink", "SELECT domain, entity, case_type, query, suggested_probe, best_score FROM {ox_gaps}")
def _(t: Tables) -> DataFrame:
    from veralytics.plans.coverage import scored

    folder = sinks.scratch(t.spark)
    sinks.gap_report_sink(V.gap_ranking(scored(t), n=None), folder)
    return t.spark.read.schema(
        "domain string, entity string, case_type string, query string, suggested_probe string, best_score double"
    ).json(folder)


_KEY = "company_id || '__' || domain_key"


@query(
    "company_domains",
    f"""SELECT company_id, company_name, domain_key, domain_name, coalesce(probe_schedule, 'manual') AS probe_schedule, {_KEY} AS domain FROM {{fx_profiles}}""",
)
def _(t: Tables) -> DataFrame:
    return P.company_domains(t["fx_profiles"])


@query(
    "domain_dim",
    f"""SELECT domain, display_name, NULL AS company_id, 'manual' AS probe_schedule FROM {{fx_domains}}
    UNION ALL SELECT {_KEY}, domain_name, company_id, coalesce(probe_schedule, 'manual') FROM {{fx_profiles}}""",
)
def _(t: Tables) -> DataFrame:
    return P.domain_dim(t.domains, t["fx_profiles"])


@query(
    "domain_label",
    f"SELECT {_KEY} AS domain_key, coalesce(company_name, company_id) || ' — ' || coalesce(domain_name, {_KEY}) AS label FROM {{fx_profiles}}".replace(
        f"coalesce(domain_name, {_KEY})", "coalesce(domain_name, domain_key)"
    ),
)
def _(t: Tables) -> DataFrame:
    return P.domain_label(t["fx_profiles"]).select("domain_key", "label")


# Documents as an index table, pages upserted twice each, then boosts; one stored probe must outlive it all.
_AT = "'d' || CAST({n} AS STRING) AS doc_id, CASE {n} % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS layer, d.domain, 'e' || CAST({n} % 10 AS STRING) AS entity"


@query(
    "index_merge",
    f"""SELECT doc_id, layer, domain, entity, text, CASE WHEN hit THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost,
      CASE WHEN hit THEN TIMESTAMP '{AS_OF}' END AS boosted_at
    FROM (SELECT *, layer = 'gold' AND (domain, entity) IN (
        SELECT d.domain, 'e' || CAST(doc_id % 10 AS STRING) FROM {{labels}} JOIN {{fx_domains}} d ON d.domain_id = doc_id % 7 WHERE toxic = 1) AS hit FROM (
      SELECT {_AT.format(n="doc_id")}, text FROM {{documents}} JOIN {{fx_domains}} d ON d.domain_id = doc_id % 7 WHERE doc_id NOT IN (SELECT page_id FROM {{pages}})
      UNION ALL SELECT {_AT.format(n="page_id")}, CASE WHEN page_id % 2 = 0 THEN url ELSE html END FROM {{pages}} JOIN {{fx_domains}} d ON d.domain_id = page_id % 7
      UNION ALL SELECT 'p1', 'probe_history', 'coupons', 'e0', 'kept'))""",
)
def _(t: Tables) -> DataFrame:
    path = f"{sinks.scratch(t.spark)}/index"

    def docs(rows: DataFrame, n: str, *more) -> DataFrame:
        n = F.col(n)
        layer = F.when(n % 3 == 0, "gold").when(n % 3 == 1, "silver").otherwise("bronze")
        placed = rows.join(t.domains.select("domain_id", "domain"), F.col("domain_id") == n % 7)
        return placed.select(
            F.concat(F.lit("d"), n.cast("string")).alias("doc_id"), layer.alias("layer"), "domain", F.concat(F.lit("e"), (n % 10).cast("string")).alias("entity"),
            F.lit(1.0).alias("boost"), F.lit(None).cast("timestamp_ntz").alias("boosted_at"), *more,
        )

    probe = t.spark.range(1).select(
        F.lit("p1").alias("doc_id"), F.lit(merge.HISTORY).alias("layer"), F.lit("coupons").alias("domain"), F.lit("e0").alias("entity"),
        F.lit(1.0).alias("boost"), F.lit(None).cast("timestamp_ntz").alias("boosted_at"), F.lit("kept").alias("text"), F.lit(1).alias("at"),
    )
    rows = docs(t["documents"], "doc_id", "text")
    merge.rebuild_index(rows.where(F.col("layer") == "gold"), path)
    merge.upsert_index(probe, path, "at")
    merge.rebuild_index(rows, path)
    again = F.array(F.struct(F.lit(1).alias("at"), F.col("html").alias("text")), F.struct((F.expr("page_id % 2 = 0").cast("int") * 2).alias("at"), F.col("url").alias("text")))
    merge.upsert_index(docs(t["pages"], "page_id", F.inline(again)), path, "at")
    toxic = t["labels"].where("toxic = 1").join(t.domains.select("domain_id", "domain"), F.col("domain_id") == F.col("doc_id") % 7)
    merge.boost_index(toxic.select("domain", F.concat(F.lit("e"), (F.col("doc_id") % 10).cast("string")).alias("entity")), path, AS_OF)
    return t.spark.read.parquet(path).select("doc_id", "layer", "domain", "entity", "text", "boost", "boosted_at")
