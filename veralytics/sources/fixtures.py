"""Domain tables derived from the driver's star-schema tables.

Each fixture is one SQL text that means the same in Spark and in DuckDB: Spark
runs it over the parquet tables, the oracle gets it as a CTE. ``{name}`` stands
for a base table or another fixture.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2024-01-31 21:00:00"
AS_OF_DATE = "2024-01-31"
AS_OF_ORDERS = "2001-08-02 00:00:00"

FIXTURES: dict[str, str] = {}

# Domain dimension: thresholds, cost, volume, class, industry, model, owner.
FIXTURES["fx_domains"] = """
SELECT domain_id, domain, CAST(fresh AS DOUBLE) AS fresh, CAST(stale AS DOUBLE) AS stale,
  CAST(cost_usd AS DOUBLE) AS cost_usd, decisions_per_month, risk_category, industry, dbt_model, owner,
  key_column, value_column, display_name
FROM (VALUES
 (0,'customer_segments',0.95,0.85,125000,450,'High','Financial_Services','fct_customer_segments','data-team@example.com','segment_name','min_annual_revenue_usd','Customer Segments'),
 (1,'product_catalog',0.92,0.75,45000,1200,'Limited','Retail','fct_product_catalog','data-team@example.com','product_name','unit_price_usd','Product Catalog'),
 (2,'risk_thresholds',0.95,0.80,280000,320,'High','Financial_Services','fct_risk_thresholds','risk-team@example.com','threshold_name','threshold_value','Risk Thresholds'),
 (3,'drug_formulary',0.90,0.70,18000,2400,'High','Healthcare','fct_drug_formulary','data-team@example.com','drug_name','tier_copay_usd','Drug Formulary'),
 (4,'coverage_limits',0.93,0.78,95000,680,'High','Insurance','fct_coverage_limits','benefits-team@example.com','coverage_type','limit_usd','Coverage Limits'),
 (5,'carrier_rates',0.91,0.76,32000,3100,'Limited','Logistics','fct_carrier_rates','network-team@example.com','route_code','rate_usd','Carrier Rates'),
 (6,'coupons',0.90,0.72,4200,5800,'Minimal','Retail','fct_coupons','pharmacy-team@example.com','coupon_code','max_savings_usd','Coupons')
) AS t(domain_id,domain,fresh,stale,cost_usd,decisions_per_month,risk_category,industry,dbt_model,owner,key_column,value_column,display_name)
"""

# Versioned facts; beliefs cover equal, K suffix, 20 % off, 60 % off, empty, prose.
FIXTURES["fx_gold"] = """
SELECT d.domain, v.entity,
  CASE WHEN k % 7 = 6 THEN p_type || ' grade'
       WHEN version = 1 THEN CAST(CAST(FLOOR(cents * 0.9) AS BIGINT) AS STRING)
       ELSE CAST(cents AS STRING) END AS value,
  CASE k % 6
    WHEN 0 THEN CASE WHEN k % 7 = 6 THEN p_type || ' grade' ELSE CAST(cents AS STRING) END
    WHEN 1 THEN CAST(CAST(FLOOR(cents / 1000) AS BIGINT) AS STRING) || 'K'
    WHEN 2 THEN '$' || CAST(CAST(FLOOR(cents * 0.8) AS BIGINT) AS STRING)
    WHEN 3 THEN CAST(CAST(FLOOR(cents * 0.4) AS BIGINT) AS STRING)
    WHEN 4 THEN '' ELSE 'STANDARD grade' END AS model_belief,
  CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN NULL ELSE 'source moved to ' || p_brand END AS staleness_reason,
  DATE '2023-01-01' + CAST(p_size * 7 AS INT) AS effective_date, version,
  CASE WHEN is_current THEN CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'True' ELSE NULL END ELSE 'false' END AS is_current,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 31 = 0 THEN 'not a date'
       ELSE CAST(DATE '2023-12-15' + CAST(k % 120 AS INT) AS STRING) END AS expiry_date,
  d.industry,
  CASE k % 4 WHEN 0 THEN 'REMOVE' WHEN 1 THEN 'UPDATE' ELSE 'NONE' END AS recommended_action,
  CASE WHEN k % 5 = 0 THEN 'Tier ' || CAST(k % 3 AS STRING) ELSE '' END AS tier,
  CASE WHEN k % 4 = 3 THEN 'true' ELSE '' END AS prior_auth
FROM (
  SELECT p.*, 2 AS version, TRUE AS is_current FROM (
    SELECT p_partkey AS k, p_name || ' #' || CAST(p_partkey AS STRING) AS entity, p_type, p_size, p_brand,
      CAST(FLOOR(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM {part}) p
  UNION ALL
  SELECT p.*, 1 AS version, FALSE AS is_current FROM (
    SELECT p_partkey AS k, p_name || ' #' || CAST(p_partkey AS STRING) AS entity, p_type, p_size, p_brand,
      CAST(FLOOR(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM {part}) p WHERE k % 2 = 0
) v JOIN {fx_domains} d ON d.domain_id = v.k % 7
"""

# Run history: view drops 3 days, error fails once, purchase drifts, signup has a gap.
FIXTURES["fx_runs"] = """
SELECT 'run-' || event_type || '-' || CAST(d AS STRING) AS run_id,
  CASE event_type WHEN 'signup' THEN 'fct_customer_segments' WHEN 'view' THEN 'fct_product_catalog'
    WHEN 'error' THEN 'fct_risk_thresholds' WHEN 'click' THEN 'fct_drug_formulary'
    ELSE 'fct_coverage_limits' END AS dbt_model,
  CAST(d AS TIMESTAMP) AS run_timestamp,
  CASE WHEN event_type = 'error' AND d = DATE '2024-01-06' THEN 'failed' ELSE 'success' END AS status,
  SUM(CASE WHEN event_type = 'view' AND d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND event_id % 2 = 0
      THEN 0 ELSE 1 END) AS rows_affected,
  CASE WHEN event_type = 'purchase' AND d >= DATE '2024-01-16' THEN 'v1.1' ELSE 'v1.0' END AS schema_version
FROM (SELECT event_id, event_type, CAST(ts AS DATE) AS d FROM {events}) e
WHERE NOT (event_type = 'signup' AND d BETWEEN DATE '2024-01-18' AND DATE '2024-01-20')
GROUP BY event_type, d
"""

# Event log: nine types, six modules, JSON payloads.
FIXTURES["fx_bus"] = """
SELECT CAST(event_id AS STRING) AS event_id, ts AS event_ts,
  CASE event_id % 9 WHEN 0 THEN 'DKSM' WHEN 1 THEN 'LCI' WHEN 2 THEN 'PP' WHEN 3 THEN 'AVL' WHEN 4 THEN 'FLE'
    WHEN 5 THEN 'FLE' WHEN 6 THEN 'PP' WHEN 7 THEN 'ASGC' ELSE 'DKSM' END AS source_module,
  CASE event_id % 9 WHEN 0 THEN 'STALENESS_DETECTED' WHEN 1 THEN 'CONTEXT_INJECTED'
    WHEN 2 THEN 'PIPELINE_FAILURE_FOUND' WHEN 3 THEN 'VALUE_CALCULATED' WHEN 4 THEN 'CORRECTION_RECEIVED'
    WHEN 5 THEN 'CORRECTION_APPLIED' WHEN 6 THEN 'APPROVAL_REQUIRED' WHEN 7 THEN 'REPROBE_REQUESTED'
    ELSE 'EXPIRY_ALERT' END AS event_type,
  d.domain, 'e' || CAST(user_id AS STRING) AS entity,
  CASE event_id % 9
    WHEN 0 THEN '{{"level":"' || CASE WHEN value >= 150 THEN 'CRITICAL' ELSE 'STALE' END || '","days_since_update":' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) || '}}'
    WHEN 1 THEN '{{"injected_value":"' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) || '"}}'
    WHEN 2 THEN '{{"failure_type":"gap","dbt_model":"' || d.dbt_model || '","days_since":' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) || '}}'
    WHEN 3 THEN '{{"exposure_usd":' || CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING) || '}}'
    WHEN 4 THEN '{{"signal_id":"SIG-' || CAST(event_id AS STRING) || '","corrected":true}}'
    WHEN 5 THEN '{{"total_recovery_usd":' || CAST(CAST(FLOOR(value * 10) AS BIGINT) AS STRING) || ',"corrected":false}}'
    WHEN 6 THEN CASE user_id % 3 WHEN 0 THEN '{{"action":"full_refresh","risk_level":"High"}}'
      WHEN 1 THEN '{{"routing_action":"reweight_chroma"}}' ELSE '{{}}' END
    WHEN 7 THEN '{{"triggered_by":"correction_applied"}}'
    ELSE CASE WHEN user_id % 5 = 0 THEN '{{"industry":"Hospitality"}}'
      ELSE '{{"days_until_expiry":' || CAST(event_id % 40 AS STRING) || ',"expiry_date":"2024-02-03","recommended_action":"REMOVE"}}' END
  END AS payload,
  CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 60 THEN 'WARNING' ELSE 'INFO' END AS severity,
  value >= 150 OR user_id % 11 = 0 AS requires_approval,
  event_id AS n, user_id, CAST(FLOOR(value) AS BIGINT) AS units, CAST(FLOOR(value * 10) AS BIGINT) AS tenths,
  CAST(FLOOR(value * 100) AS BIGINT) AS cents
FROM {events} JOIN {fx_domains} d ON d.domain_id = user_id % 7
"""

# Injections and their four-hour validity: the view events.
FIXTURES["fx_injections"] = """
SELECT 'inj' || CAST(event_id AS STRING) AS injection_id, ts AS injected_at, d.domain,
  'e' || CAST(user_id AS STRING) AS entity, CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) AS injected_value,
  ts + INTERVAL 4 HOUR AS expires_at
FROM {events} JOIN {fx_domains} d ON d.domain_id = user_id % 7 WHERE event_type = 'view'
"""

# Business outcomes: the purchase and click events.
FIXTURES["fx_outcomes"] = """
SELECT event_id AS outcome_id, ts AS outcome_ts, d.domain, CAST(FLOOR(value * 100) AS BIGINT) AS value_cents,
  event_id % 3 <> 0 AS used_stale_context, event_id % 5 < 2 AS correction_applied
FROM {events} JOIN {fx_domains} d ON d.domain_id = user_id % 7 WHERE event_type IN ('purchase', 'click')
"""

FIXTURES["fx_decisions"] = """
SELECT o_orderkey AS decision_id, o_orderdate AS decided_at, d.domain, o_orderstatus AS decision_outcome,
  CAST(FLOOR(o_totalprice * 100 + 0.5) AS BIGINT) AS risk_cents
FROM {orders} JOIN {fx_domains} d ON d.domain_id = o_custkey % 7
"""

# Correction signals: numeric, disjoint, overlapping and empty pairs.
FIXTURES["fx_feedback"] = """
SELECT 'SIG-' || CAST(event_id AS STRING) AS signal_id, ts AS signal_ts,
  CASE event_id % 5 WHEN 0 THEN 'user_correction' WHEN 1 THEN 'agent_override' WHEN 2 THEN 'escalation'
    WHEN 3 THEN 'non_use' ELSE 'other' END AS signal_type,
  d.domain, 'e' || CAST(user_id AS STRING) AS entity,
  CASE event_id % 4 WHEN 0 THEN CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING) WHEN 1 THEN 'alpha beta gamma'
    WHEN 2 THEN 'gold tier' ELSE '' END AS wrong_value,
  CASE event_id % 4 WHEN 0 THEN CAST(CAST(FLOOR(value * (60 + event_id % 50)) AS BIGINT) + 1 AS STRING) WHEN 1 THEN 'delta'
    WHEN 2 THEN 'gold segment' ELSE 'x' END AS correct_value,
  CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS confidence,
  CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'classified' WHEN 2 THEN 'classified' ELSE 'applied' END AS fle_status
FROM {events} JOIN {fx_domains} d ON d.domain_id = user_id % 7 WHERE event_type IN ('click', 'error')
"""

FIXTURES["fx_bronze"] = """
SELECT d.domain, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS segment_name,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS STRING) END AS min_annual_revenue,
  c_mktsegment AS support_tier, CASE WHEN c_custkey % 17 = 0 THEN 'true' ELSE 'false' END AS is_duplicate,
  CASE WHEN c_custkey % 13 = 0 THEN 'True' WHEN c_custkey % 23 = 0 THEN 'true' ELSE 'false' END AS has_nulls
FROM {customer} JOIN {fx_domains} d ON d.domain_id = c_custkey % 7
"""

# Bronze rows with the columns of three domains' rules; a blank or null cell here and there.
FIXTURES["fx_bronze_wide"] = """
SELECT b.*, CASE WHEN b.c_custkey % 29 = 0 THEN '' ELSE CAST(b.c_custkey * 10 AS STRING) END AS max_annual_revenue,
  CAST(b.c_custkey % 30 AS STRING) AS discount_rate_pct, c_name AS product_name, c_mktsegment AS category,
  CASE WHEN b.c_custkey % 31 = 0 THEN NULL ELSE CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS STRING) END AS unit_price_usd,
  'true' AS discount_eligible, CASE WHEN b.c_custkey % 5 = 0 THEN ' ' ELSE '2024-01-01' END AS launch_date,
  c_name AS threshold_name, c_mktsegment AS risk_category, CASE WHEN b.c_custkey % 3 = 0 THEN NULL ELSE CAST(b.c_custkey AS STRING) END AS max_value,
  'usd' AS unit, 'high' AS severity_level
FROM {fx_bronze} b JOIN {customer} c ON c.c_custkey = b.c_custkey
"""

# Graded probe attempts: the assistant turns of conversations.
FIXTURES["fx_attempts"] = """
SELECT conv_id AS probe_id, turn AS attempt, LENGTH(text) AS n,
  CASE LENGTH(text) % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS grade,
  CASE WHEN LENGTH(text) % 3 = 0 THEN CAST(LENGTH(text) AS STRING) END AS extracted_value,
  CAST(LENGTH(text) % 100 AS DOUBLE) / 100 AS confidence, LENGTH(text) AS cost_micros
FROM {conversations} WHERE role = 'assistant'
"""

# Context rows per probe: the user turns, ranked by length.
FIXTURES["fx_context"] = """
SELECT conv_id AS probe_id, 'turn ' || CAST(turn AS STRING) AS entity, CAST(LENGTH(text) AS STRING) AS current_value,
  CAST(LENGTH(text) AS DOUBLE) AS similarity_score
FROM {conversations} WHERE role = 'user'
"""

# Schedules and last run times per company domain.
FIXTURES["fx_sched"] = """
SELECT 'co' || CAST(user_id AS STRING) || '__' || event_type AS domain_key,
  CASE user_id % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'manual' ELSE 'daily' END AS schedule,
  CASE WHEN user_id % 5 = 4 AND event_type = 'view' THEN NULL ELSE MAX(ts) END AS last_run
FROM {events} GROUP BY user_id, event_type
"""

# Similarity series per entity, as exact fractions of whole numbers.
FIXTURES["fx_history"] = """
SELECT d.domain, 'e' || CAST(user_id AS STRING) AS entity, CAST(ts AS DATE) AS probe_date,
  COUNT(*) AS n, CAST(SUM(CAST(FLOOR(value * 100) AS BIGINT)) AS BIGINT) AS sim_num
FROM {events} JOIN {fx_domains} d ON d.domain_id = user_id % 7 GROUP BY d.domain, user_id, CAST(ts AS DATE)
"""

FIXTURES["fx_answers"] = """
SELECT p_partkey AS k, p_type AS gold_value,
  CASE p_partkey % 5 WHEN 0 THEN p_type || '.' WHEN 1 THEN ' ' || LOWER(p_type) WHEN 2 THEN 'other'
    WHEN 3 THEN '[unavailable]' ELSE 'x' END AS answer_a,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'other' WHEN 2 THEN '[unavailable]' ELSE 'y' END AS answer_b
FROM {part}
"""

# Stored probes: every event probes a fact, so facts have several probes of different beliefs.
FIXTURES["fx_probes"] = """
SELECT d.domain, p_name || ' #' || CAST(p_partkey AS STRING) AS entity, ts AS probe_ts,
  CAST(CAST(FLOOR(p_retailprice * 100 * (0.5 + (event_id % 6) * 0.1)) AS BIGINT) AS STRING) AS model_belief, event_id AS probe_id
FROM (SELECT *, event_id % (SELECT COUNT(*) FROM {part}) + 1 AS probed FROM {events}) e
JOIN {part} ON p_partkey = probed JOIN {fx_domains} d ON d.domain_id = p_partkey % 7
"""

# Requests for single entities: exact, upper case, part of the name, unknown, blank.
FIXTURES["fx_requests"] = """
SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 13 = 5 THEN 'no_such_domain' ELSE d.domain END AS domain,
  CASE s_suppkey % 6 WHEN 0 THEN p_name || ' #' || CAST(p_partkey AS STRING) WHEN 1 THEN UPPER(p_name) || ' #' || CAST(p_partkey AS STRING)
    WHEN 2 THEN '#' || CAST(p_partkey AS STRING) WHEN 3 THEN p_name WHEN 4 THEN 'no such thing' ELSE ' ' END AS entity,
  CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE 'price of ' || p_name END AS query,
  CAST(s_suppkey % 14 AS INT) AS top_k
FROM {supplier} JOIN {part} ON p_partkey = s_suppkey JOIN {fx_domains} d ON d.domain_id = p_partkey % 7
"""

# Company profiles: one company per nation, one domain per supplier.
FIXTURES["fx_profiles"] = """
SELECT LOWER(n_name) AS company_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'Company ' || n_name END AS company_name,
  LOWER(s_name) AS domain_key, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Domain of ' || s_name END AS domain_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE NULL END AS probe_schedule
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
"""

# Documents in three layers; those without a vector take no part in vector searches.
FIXTURES["fx_docs"] = """
SELECT doc_id, d.domain, CASE doc_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS layer,
  'e' || COALESCE(CAST(label AS STRING), '') || '-' || lang AS entity, CAST(n_chars AS STRING) AS value, text, embedding,
  CASE WHEN label = 3 THEN 1.5 ELSE CAST(1.0 AS DOUBLE) END AS boost
FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id JOIN {fx_domains} d ON d.domain_id = doc_id % 7
"""

FIXTURES["fx_queries"] = """
SELECT item_id AS query_id, text AS query, embedding, d.domain
FROM {benchmark} JOIN {embeddings} ON vec_id = item_id JOIN {fx_domains} d ON d.domain_id = item_id % 7
"""

_NAME = re.compile(r"(?<!\{)\{([a-z][a-z_0-9]*)\}(?!\})")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: put every fixture the text needs in front of it as a CTE."""
    known = {**FIXTURES, **(extra or {}), **ORACLE_PARTS}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(sql)

    def render(text: str) -> str:
        return _NAME.sub(r"\1", text.strip()).replace("{{", "{").replace("}}", "}")

    ctes = [f"{n} AS ({render(known[n])})" for n in ordered]
    body = render(sql)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Reusable oracle-only CTEs (never run by Spark); filled by the plan modules.
ORACLE_PARTS: dict[str, str] = {}


class Tables:
    """Driver tables and fixtures of one scale directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = FIXTURES[name]
                df = _zone_free(self.spark.sql(sql, **{n: self[n] for n in _names(sql)}))
            self._made[name] = df
        return self._made[name]

    @cached_property
    def domains(self) -> DataFrame:
        return self["fx_domains"]

    @cached_property
    def gold(self) -> DataFrame:
        return self["fx_gold"]

    @cached_property
    def bus(self) -> DataFrame:
        """The event log with its nine log columns."""
        return self["fx_bus"].select(
            "event_id", "event_ts", "source_module", "event_type", "domain", "entity",
            "payload", "severity", "requires_approval",
        )


def _zone_free(df: DataFrame) -> DataFrame:
    """Turn zoned timestamps into plain ones, the type of the source tables."""
    return df.select(
        *[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes]
    )
