"""Constants, lookup tables and texts that decide results."""

from __future__ import annotations

# --- staleness ---------------------------------------------------------------
DEFAULT_FRESH = 0.90
DEFAULT_STALE = 0.70
DECAY_DAYS = 180.0
DECAY_WEIGHT = 0.3
UNKNOWN_CONFIDENCE = 0.1
BASE_CONFIDENCE = 0.6
BAND_FRESH = 0.15
BAND_STALE = 0.40
LEVELS = ("FRESH", "STALE", "CRITICAL", "UNKNOWN")
AGE_FRESH_DAYS = 30
AGE_STALE_DAYS = 90
AGE_CRITICAL_DAYS = 180

# --- medallion ---------------------------------------------------------------
SILVER_QUALITY_THRESHOLD = 0.95
REQUIRED_COLUMNS = {
    "customer_segments": [
        "segment_name", "min_annual_revenue", "max_annual_revenue", "support_tier", "discount_rate_pct",
    ],
    "product_catalog": ["product_name", "category", "unit_price_usd", "discount_eligible", "launch_date"],
    "risk_thresholds": ["threshold_name", "risk_category", "max_value", "unit", "severity_level"],
}
SILVER_RENAMES = {
    "customer_segments": {
        "min_annual_revenue": "min_annual_revenue_usd",
        "max_annual_revenue": "max_annual_revenue_usd",
    },
    "product_catalog": {},
    "risk_thresholds": {"max_value": "threshold_value"},
}

# --- risk --------------------------------------------------------------------
WRONG_RATE = {"CRITICAL": 0.65, "STALE": 0.30, "FRESH": 0.02, "UNKNOWN": 0.50}
WRONG_RATE_DEFAULT = 0.30
DEFAULT_DECISIONS_PER_MONTH = 100
DEFAULT_COST_USD = 50_000.0
GRADE_LIMITS = (("A", 100_000), ("B", 500_000), ("C", 1_000_000), ("D", 5_000_000))
WORST_GRADE = "F"

# --- value ledger ------------------------------------------------------------
ERROR_RATE = 0.15
AVG_DECISION_VALUE_USD = 50_000
RECOVERABLE_SHARE = 0.65
FIX_COST_USD = 5_000
LINK_HOURS = 4
DEFAULT_RISK_CATEGORY = "Limited"
RISK_CATEGORY = {
    "customer_segments": "High",
    "risk_thresholds": "High",
    "product_catalog": "Limited",
    "drug_formulary": "High",
    "coverage_limits": "High",
    "carrier_rates": "Limited",
    "coupons": "Minimal",
}

# --- probing -----------------------------------------------------------------
MAX_RETRIES = 2
PROBE_TTL_HOURS = 24
COST_DEFAULT_PER_1K = 0.003
COST_PER_1K = {
    "claude-haiku-4-5-20251001": 0.00025,
    "claude-sonnet-4-6": 0.003,
    "claude-opus-4-7": 0.015,
}
UNAVAILABLE = "[unavailable]"
ANSWER_ERROR = "[error]"
MAX_ENTITY_CHARS = 200
MIN_TOP_K = 1
MAX_TOP_K = 10
SNIPPET_CHARS = 300

# --- retrieval ---------------------------------------------------------------
DENSE_WEIGHT = 0.6
BM25_WEIGHT = 0.4
BM25_K1 = 1.5
BM25_B = 0.75
BOOST = 1.5
DOC_ID_CHARS = 512
SLUG_CHARS = 64
PROBE_QUESTION_CHARS = 500
SIMILAR_PROBES = 10
LAYER_COLLECTIONS = {
    "gold": ["gold"],
    "silver": ["gold", "silver"],
    "bronze": ["bronze"],
    "all": ["gold", "silver", "bronze"],
}

# --- coverage ----------------------------------------------------------------
COVERAGE_THRESHOLD = 0.55
TOP_GAPS = 10

# --- events ------------------------------------------------------------------
EVENT_LABELS = {
    "STALENESS_DETECTED": "🔴 DKSM detected staleness",
    "CONTEXT_INJECTED": "💉 LCI injected verified context",
    "PIPELINE_FAILURE_FOUND": "⚙️ PP found pipeline root cause",
    "VALUE_CALCULATED": "💰 AVL calculated financial exposure",
    "CORRECTION_RECEIVED": "📥 FLE received correction signal",
    "CORRECTION_APPLIED": "✅ FLE applied correction",
    "APPROVAL_REQUIRED": "⏳ ASGC approval requested",
    "APPROVAL_GRANTED": "✅ ASGC approved action",
    "APPROVAL_REJECTED": "❌ ASGC rejected action",
}
TIMELINE_ROWS = 60
EXPIRY_CARDS = 8
BOARD_ROWS = 10
SUMMARY_CHARS = 200

# --- injection ---------------------------------------------------------------
INJECTION_TTL_HOURS = 4
QUERY_PREVIEW_CHARS = 120

# --- root cause --------------------------------------------------------------
LOOKBACK_DAYS = 180
DROP_RATIO = 0.70
GAP_HOURS = 24
CRITICAL_AFTER_DAYS = 30
DEFAULT_OWNER = "unknown@company.com"
# failure class, position, action, description, minutes, risk, automatic
REMEDIATION_OPTIONS = [
    ("silent_drop", 1, "refresh", "Re-run the dbt model (incremental)", 8, "Low", True),
    ("silent_drop", 2, "full_refresh", "Full rebuild of the model", 45, "Medium", False),
    ("silent_drop", 3, "alert_only", "Notify owner, no auto-action", 1, "Low", True),
    ("schema_drift", 1, "schema_patch", "Apply schema migration and re-run", 30, "High", False),
    ("schema_drift", 2, "alert_only", "Notify owner for manual review", 1, "Low", True),
    ("gap", 1, "refresh", "Re-run missed incremental loads", 15, "Low", True),
    ("gap", 2, "alert_only", "Notify owner of pipeline gap", 1, "Low", True),
    ("hard_failure", 1, "full_refresh", "Full rebuild after source fix", 60, "High", False),
    ("hard_failure", 2, "alert_only", "Escalate to data engineering team", 1, "Low", True),
    ("unknown", 1, "alert_only", "No pattern detected — alert only", 1, "Low", True),
]
REMEDIATED_RUN = {"duration_seconds": 90, "rows_affected": 10_000, "schema_version": "v-remediated"}

# --- feedback ----------------------------------------------------------------
SIGNAL_TYPES = ("user_correction", "agent_override", "escalation", "non_use")
DEFAULT_SIGNAL_TYPE = "user_correction"
MIN_SIGNAL_CONFIDENCE = 0.7
THRESHOLD_REL_DIFF = 0.20
TOKEN_OVERLAP = 0.3
RETRAIN_THRESHOLD = 10
LOW_VELOCITY = 0.3
# error class, action, automatic, approval rule
ROUTES = [
    ("THRESHOLD_ERROR", "flag_gold_and_reprobe", False, "unless_auto"),
    ("DEFINITION_ERROR", "flag_domain_definition", False, "always"),
    ("RETRIEVAL_ERROR", "reweight_chroma", True, "never"),
    ("CLASSIFICATION_ERROR", "update_gold_and_reprobe", False, "unless_auto"),
]

# --- schedules, expiry, notification ------------------------------------------
SCHEDULE_SECONDS = {"hourly": 3_600, "daily": 86_400, "weekly": 604_800}
EXPIRY_WARN_DAYS = 30
EXPIRY_CRITICAL_DAYS = 7
INDUSTRY_WARN_DAYS = {
    "Financial_Services": 30,
    "Healthcare": 60,
    "Insurance": 90,
    "Logistics": 30,
    "Retail": 7,
}
NOTIFY_TYPES = ("EXPIRY_ALERT", "STALENESS_DETECTED", "PIPELINE_FAILURE_FOUND", "DATA_CONTRACT_EXPIRY")
DIGEST_HOURS = 24
LOG_ONLY = "log_only"
DEFAULT_INDUSTRY = "General"
DOMAIN_INDUSTRY = {
    "customer_segments": "Financial_Services",
    "risk_thresholds": "Financial_Services",
    "loan_notations": "Financial_Services",
    "product_catalog": "Retail",
    "coupons": "Retail",
    "clearance": "Retail",
    "drug_formulary": "Healthcare",
    "billing_codes": "Healthcare",
    "carrier_rates": "Logistics",
    "sla_windows": "Logistics",
    "premium_tables": "Insurance",
    "coverage_limits": "Insurance",
    "rate_plans": "Hospitality",
    "loyalty_tiers": "Hospitality",
}
REASON_CHARS = 80
RECENT_ROWS = 50
