"""SQL building blocks for the oracles, written independently of the operators."""

from __future__ import annotations

from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS

NUM = r"([0-9]+(?:\.[0-9]+)?)\s*([BbMmKk%])?"
WORD = r"[\p{L}\p{N}_]+"


def number(text: str) -> str:
    bare = f"replace({text}, ',', '')"
    base = f"TRY_CAST(regexp_extract({bare}, '{NUM}', 1) AS DOUBLE)"
    return (
        f"CASE upper(regexp_extract({bare}, '{NUM}', 2)) WHEN 'B' THEN {base} * 1000000000 "
        f"WHEN 'M' THEN {base} * 1000000 WHEN 'K' THEN {base} * 1000 WHEN '%' THEN {base} / 100 ELSE {base} END"
    )


def words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '{WORD}'))"


def jaccard(left: str, right: str) -> str:
    return (
        f"CASE WHEN len({left}) > 0 AND len({right}) > 0 THEN CAST(len(list_intersect({left}, {right})) AS DOUBLE) / "
        f"(len({left}) + len({right}) - len(list_intersect({left}, {right}))) ELSE CAST(0 AS DOUBLE) END"
    )


def scores(pairs: str, as_of: str = AS_OF) -> str:
    """Score rows of a relation with domain, model_belief, warehouse_truth and effective_date."""
    return f"""
SELECT * EXCLUDE (bn, tn, bw, tw, known, sim0, days0, fresh, stale),
  CASE WHEN NOT known THEN CAST(1 AS DOUBLE)
    ELSE round(least((1 - sim0) * (1 + CAST(0.3 AS DOUBLE) * (1 - exp(-CAST(days0 AS DOUBLE) / 180))), 1), 4) END AS staleness_score,
  CASE WHEN NOT known THEN 'UNKNOWN' WHEN sim0 >= coalesce(fresh, 0.9) THEN 'FRESH'
    WHEN sim0 >= coalesce(stale, 0.7) THEN 'STALE' ELSE 'CRITICAL' END AS staleness_level,
  CASE WHEN known THEN sim0 ELSE CAST(0 AS DOUBLE) END AS semantic_similarity,
  CASE WHEN known THEN abs(bn - tn) < 1 END AS numeric_match,
  CASE WHEN known THEN days0 ELSE 0 END AS days_since_update,
  CASE WHEN known THEN round(CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * sim0, 4) ELSE CAST(0.1 AS DOUBLE) END AS confidence
FROM (
  SELECT n.*, d.fresh, d.stale,
    CASE WHEN bn IS NOT NULL AND tn > 0 THEN round(least(bn, tn) / greatest(bn, tn), 4)
      ELSE round({jaccard("bw", "tw")}, 4) END AS sim0
  FROM (
    SELECT p.*, model_belief <> '' AND warehouse_truth <> '' AS known,
      {number("model_belief")} AS bn, {number("warehouse_truth")} AS tn,
      {words("model_belief")} AS bw, {words("warehouse_truth")} AS tw,
      CAST(floor(epoch(TIMESTAMP '{as_of}' - CAST(effective_date AS TIMESTAMP)) / 86400) AS INT) AS days0
    FROM {pairs} p
  ) n LEFT JOIN {{fx_domains}} d USING (domain)
)
"""


def risk(scored: str, window: int = 30) -> str:
    return f"""
SELECT *, round(decisions_at_risk * avg_cost_usd, 2) AS estimated_exposure_usd FROM (
  SELECT *, CAST(floor(decisions_in_window * wrong_decision_rate) AS BIGINT) AS decisions_at_risk FROM (
    SELECT s.*, CAST(floor(coalesce(d.decisions_per_month, 100) * {window} / 30) AS BIGINT) AS decisions_in_window,
      round(CAST(CASE staleness_level WHEN 'CRITICAL' THEN 0.65 WHEN 'STALE' THEN 0.3 WHEN 'FRESH' THEN 0.02
        WHEN 'UNKNOWN' THEN 0.5 ELSE 0.3 END AS DOUBLE) * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * staleness_score), 4) AS wrong_decision_rate,
      coalesce(d.cost_usd, CAST(50000 AS DOUBLE)) AS avg_cost_usd
    FROM {scored} s LEFT JOIN {{fx_domains}} d USING (domain)))
"""


ORACLE_PARTS["ox_current"] = (
    "SELECT * FROM {fx_gold} WHERE lower(coalesce(is_current, 'true')) IN ('true', '1', 'yes')"
)
ORACLE_PARTS["ox_raw"] = (
    "SELECT domain, entity, model_belief, value AS warehouse_truth, effective_date FROM {ox_current}"
)
ORACLE_PARTS["ox_pairs"] = """
SELECT domain, entity, CASE WHEN model_belief IS NULL OR model_belief IN ('', 'nan') THEN value ELSE model_belief END AS model_belief,
  value AS warehouse_truth, effective_date, staleness_reason FROM {ox_current}
"""
ORACLE_PARTS["ox_scores"] = scores("{ox_raw}")
ORACLE_PARTS["ox_probed"] = scores("{ox_pairs}")
ORACLE_PARTS["ox_risk"] = risk("{ox_scores}")
