"""Queries over probe coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.operators import coverage as V
from veralytics.plans.oracle_parts import jaccard, words
from veralytics.plans.registry import query
from veralytics.sources.fixtures import ORACLE_PARTS, Tables

ORACLE_PARTS["ox_cases"] = """
SELECT domain, entity, case_no, case_type, query FROM (
  SELECT domain, entity, unnest([1, 2, 3, 4, 5, 6, 7]) AS case_no,
    unnest(['exact_value', 'tier', 'auth', 'comparison', 'expiry', 'boundary', 'stale_belief']) AS case_type,
    unnest(['What is the ' || label || ' for ' || entity || '?',
      CASE WHEN tier <> '' THEN 'What tier or category is ' || entity || ' assigned to in ' || display_name || '?' END,
      CASE WHEN prior_auth <> '' THEN 'Does ' || entity || ' require prior authorization or special approval?' END,
      'How does ' || entity || ' compare to other items in ' || display_name || '?',
      CASE WHEN expiry_date <> '' THEN 'When does ' || entity || '''s current ' || label || ' expire or change?' END,
      'What is the boundary or threshold that defines ' || entity || ' in ' || display_name || '?',
      CASE WHEN model_belief <> '' AND trim(model_belief) <> trim(value) THEN 'Has ' || entity || '''s ' || label || ' changed from ' || model_belief || ' to a new value recently?' END]) AS query
  FROM (SELECT g.*, d.display_name, trim(replace(replace(d.value_column, '_', ' '), 'usd', '')) AS label FROM {ox_current} g JOIN {fx_domains} d USING (domain)))
WHERE query IS NOT NULL
"""
# The benchmark texts are the probe questions.
ORACLE_PARTS["ox_questions"] = """
SELECT d.domain, item_id AS pos, text AS question FROM {benchmark} JOIN {fx_domains} d ON d.domain_id = item_id % 7
"""
ORACLE_PARTS["ox_best_text"] = f"""
SELECT c.domain, c.entity, c.case_no, c.case_type, c.query, b.best_probe, coalesce(b.best_score, 0) AS best_score, coalesce(b.best_score, 0) >= CAST(0.02 AS DOUBLE) AS covered
FROM {{ox_cases}} c LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY domain, entity, case_no ORDER BY s DESC, pos) AS rn, round(s, 4) AS best_score FROM (
    SELECT c.domain, c.entity, c.case_no, p.pos, p.question AS best_probe, {jaccard('c.w', 'p.w')} AS s
    FROM (SELECT *, {words('query')} AS w FROM {{ox_cases}}) c JOIN (SELECT *, {words('question')} AS w FROM {{ox_questions}}) p USING (domain))) b
  ON b.domain = c.domain AND b.entity = c.entity AND b.case_no = c.case_no AND b.rn = 1
"""


def cases(t: Tables) -> DataFrame:
    return V.edge_cases(t.gold, t.domains)


def questions(t: Tables) -> DataFrame:
    asked = t["benchmark"].join(t.domains, F.col("domain_id") == F.col("item_id") % 7)
    return asked.select("domain", F.col("item_id").alias("pos"), F.col("text").alias("question"))


def scored(t: Tables) -> DataFrame:
    return V.best_probe_text(cases(t), questions(t), threshold=0.02)


@query("edge_cases", "SELECT * FROM {ox_cases}")
def _(t: Tables) -> DataFrame:
    return cases(t)


@query("best_probe_text", "SELECT * FROM {ox_best_text}")
def _(t: Tables) -> DataFrame:
    return scored(t)


# Every vector is a probe of its label and a case of the next label.
@query(
    "best_probe",
    """SELECT case_id, domain, pos AS best_pos, round(s, 4) AS best_score, round(s, 4) >= CAST(0.3 AS DOUBLE) AS covered FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, pos) AS rn FROM (
        SELECT c.vec_id AS case_id, CAST(p.label AS STRING) AS domain, p.vec_id AS pos,
          round(greatest(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 0), 12) AS s
        FROM {embeddings} c JOIN {embeddings} p ON p.label = (c.label + 1) % 10)) WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    vectors = t["embeddings"]
    asked = vectors.select(F.col("vec_id").alias("case_id"), ((F.col("label") + 1) % 10).cast("string").alias("domain"), "embedding")
    probes = vectors.select(F.col("vec_id").alias("pos"), F.col("label").cast("string").alias("domain"), "embedding")
    return V.best_probe(asked, probes, threshold=0.3)


ORACLE_PARTS["ox_coverage"] = """
SELECT *, total_edge_cases - covered_count AS uncovered_count, CASE WHEN total_edge_cases > 0 THEN round(covered_count * CAST(100 AS DOUBLE) / total_edge_cases, 1) ELSE 0 END AS coverage_pct
FROM (SELECT d.domain, coalesce(p.n, 0) AS total_probes, coalesce(c.n, 0) AS total_edge_cases, coalesce(c.k, 0) AS covered_count
  FROM {fx_domains} d LEFT JOIN (SELECT domain, count(*) AS n FROM {ox_questions} GROUP BY 1) p USING (domain)
  LEFT JOIN (SELECT domain, count(*) AS n, count(*) FILTER (covered) AS k FROM {ox_best_text} GROUP BY 1) c USING (domain))
"""


@query("coverage_report", "SELECT * FROM {ox_coverage}")
def _(t: Tables) -> DataFrame:
    return V.coverage_report(t.domains, scored(t), questions(t))


@query("entity_coverage", "SELECT domain, entity, bool_and(covered) AS fully_covered, count(*) FILTER (NOT covered) AS gaps FROM {ox_best_text} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return V.entity_coverage(scored(t))


ORACLE_PARTS["ox_gaps"] = """
SELECT g.*, n.entity_gaps, CASE case_type WHEN 'exact_value' THEN 'What is the current ' || entity || ' value?'
    WHEN 'tier' THEN 'What tier or classification does ' || entity || ' belong to?' WHEN 'auth' THEN 'Does ' || entity || ' require any prior authorization or approval?'
    WHEN 'comparison' THEN 'How does ' || entity || ' differ from similar items in the same domain?'
    WHEN 'expiry' THEN 'When is ' || entity || '''s current value scheduled to change or expire?' WHEN 'boundary' THEN 'What boundary or threshold defines ' || entity || '?'
    ELSE 'Has ' || entity || '''s value been updated recently — what is the current figure?' END AS suggested_probe
FROM {ox_best_text} g JOIN (SELECT entity, count(*) AS entity_gaps FROM {ox_best_text} WHERE NOT covered GROUP BY 1) n USING (entity) WHERE NOT covered
"""


@query("suggest_probes", "SELECT domain, entity, case_type, suggested_probe FROM {ox_gaps}")
def _(t: Tables) -> DataFrame:
    return V.suggest_probes(scored(t).filter(~F.col("covered"))).select("domain", "entity", "case_type", "suggested_probe")


@query(
    "gap_ranking",
    """SELECT domain, entity, case_type, best_score, entity_gaps, suggested_probe FROM {ox_gaps} ORDER BY entity_gaps DESC, best_score, domain, entity, case_type LIMIT 10""",
)
def _(t: Tables) -> DataFrame:
    return V.gap_ranking(scored(t)).select("domain", "entity", "case_type", "best_score", "entity_gaps", "suggested_probe")


@query(
    "coverage_overall",
    """SELECT CAST(sum(covered_count) AS BIGINT) AS covered, CAST(sum(total_edge_cases) AS BIGINT) AS cases,
      round(sum(covered_count) * CAST(100 AS DOUBLE) / sum(total_edge_cases), 1) AS coverage_pct FROM {ox_coverage}""",
)
def _(t: Tables) -> DataFrame:
    return V.coverage_overall(V.coverage_report(t.domains, scored(t), questions(t)))
