"""Column layouts of the tables that are read and appended."""

from __future__ import annotations

EVENT = (
    "event_id string, event_ts timestamp_ntz, source_module string, event_type string, domain string, entity string, "
    "payload string, severity string, requires_approval boolean"
)
EVENT_JSON = (
    "event_id string, timestamp string, source_module string, event_type string, domain string, entity string, "
    "payload string, severity string, requires_approval boolean, _corrupt_record string"
)
GOLD = (
    "domain string, entity string, value string, attrs map<string,string>, model_belief string, effective_date string, "
    "version string, is_current string, expiry_date string, industry string, recommended_action string, staleness_reason string"
)
RUN = (
    "run_id string, dbt_model string, domain string, run_timestamp timestamp_ntz, status string, duration_seconds double, "
    "rows_affected bigint, error_message string, schema_version string, source_table string"
)
RUN_RESULTS = (
    "metadata struct<generated_at: string>, results array<struct<unique_id: string, status: string, execution_time: double, "
    "adapter_response: struct<rows_affected: bigint>, message: string>>"
)
DECISION = "timestamp string, domain string, decision_outcome string, risk_amount_usd double"
SCHEDULE_LOG = (
    "run_id string, company_id string, domain_key string, entity string, staleness_level string, semantic_similarity double, "
    "model_belief string, warehouse_truth string, staleness_reason string, scheduled_at timestamp_ntz, "
    "completed_at timestamp_ntz, triggered_by string"
)
CRAG_LOG = (
    "timestamp timestamp_ntz, question string, grade string, confidence double, retries_used int, "
    "final_extracted_value string, cost_usd double"
)
INJECTION_LOG = (
    "injection_id string, injected_at timestamp_ntz, domain string, entity string, injected_value string, "
    "query_preview string, source_version string, expires_at timestamp_ntz, triggered_by string"
)
FEEDBACK_LOG = (
    "signal_id string, signal_ts timestamp_ntz, signal_type string, domain string, entity string, wrong_value string, "
    "correct_value string, confidence double, fle_status string, propagated boolean"
)
APPROVAL_QUEUE = (
    "request_id string, requested_at timestamp_ntz, source_module string, event_type string, domain string, entity string, "
    "proposed_action string, risk_level string, payload_summary string, status string, decided_by string, "
    "decided_at timestamp_ntz"
)
NOTIFICATION_LOG = (
    "event_ts timestamp_ntz, event_type string, domain string, entity string, industry string, severity string, "
    "channel string, recipients string"
)
PROFILE = (
    "company struct<id: string, display_name: string>, domains map<string, struct<display_name: string, probe_schedule: string, "
    "probe_questions: array<string>, staleness_thresholds: struct<fresh: double, stale: double, critical: double>, "
    "business_impact: map<string, double>, medallion: struct<gold: struct<path: string, key_column: string, value_column: string>>>>"
)
