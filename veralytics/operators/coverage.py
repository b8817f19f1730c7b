"""How well the probe questions cover the cases of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.functions import text
from veralytics.functions.numbers import ratio
from veralytics.operators.medallion import gold_current
from veralytics.operators.term_join import nearest_by_words
from veralytics.operators.vector_join import is_bounded, nearest

# Probes of a domain compared per row; longer lists are compared piece by piece.
PROBE_CHUNK = 256


def edge_cases(gold: DataFrame, domains: DataFrame) -> DataFrame:
    """Up to seven questions per current entity.

    Exact value, comparison and boundary always; tier, auth and expiry where the attribute
    is filled; stale_belief where a belief differs from the value.
    """
    labels = domains.select(
        "domain",
        F.col("display_name").alias("_display"),
        F.trim(F.replace(F.replace("value_column", F.lit("_"), F.lit(" ")), F.lit("usd"), F.lit(""))).alias("_label"),
    )
    rows = gold_current(gold).join(labels, "domain")
    e, shown, label = F.col("entity"), F.col("_display"), F.col("_label")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""

    belief = F.col("model_belief")
    case = [
        (1, "exact_value", None, F.concat(F.lit("What is the "), label, F.lit(" for "), e, F.lit("?"))),
        (2, "tier", filled("tier"), F.concat(F.lit("What tier or category is "), e, F.lit(" assigned to in "), shown, F.lit("?"))),
        (3, "auth", filled("prior_auth"), F.concat(F.lit("Does "), e, F.lit(" require prior authorization or special approval?"))),
        (4, "comparison", None, F.concat(F.lit("How does "), e, F.lit(" compare to other items in "), shown, F.lit("?"))),
        (5, "expiry", filled("expiry_date"), F.concat(F.lit("When does "), e, F.lit("'s current "), label, F.lit(" expire or change?"))),
        (6, "boundary", None, F.concat(F.lit("What is the boundary or threshold that defines "), e, F.lit(" in "), shown, F.lit("?"))),
        (
            7,
            "stale_belief",
            filled("model_belief") & (text.stripped(F.col("model_belief")) != text.stripped(F.col("value"))),
            F.concat(F.lit("Has "), e, F.lit("'s "), label, F.lit(" changed from "), belief, F.lit(" to a new value recently?")),
        ),
    ]
    structs = []
    for number, name, wanted, question in case:
        item = F.struct(F.lit(number).alias("case_no"), F.lit(name).alias("case_type"), question.alias("query"))
        structs.append(item if wanted is None else F.when(wanted, item))
    return rows.select("domain", "entity", F.explode(F.array_compact(F.array(*structs))).alias("_c")).select("domain", "entity", "_c.*")


def best_probe(cases: DataFrame, probes: DataFrame, threshold: float = C.COVERAGE_THRESHOLD) -> DataFrame:
    """Nearest probe of the same domain per case, by vectors.

    ``cases`` (case_id, domain, embedding), ``probes`` (pos, domain, embedding); the first
    probe wins ties.
    """
    near = nearest(
        cases.select(F.col("case_id").alias("query_id"), "domain", "embedding"),
        probes.select(F.col("pos").alias("doc_id"), "domain", "embedding"),
        "domain",
    )
    best = near.select(F.col("query_id").alias("case_id"), "domain", F.col("doc_id").alias("best_pos"), F.round("score", 4).alias("best_score"))
    return _covered(cases.drop("embedding").join(best, ["case_id", "domain"], "left"), threshold)


def best_probe_text(cases: DataFrame, probes: DataFrame, threshold: float = C.COVERAGE_THRESHOLD) -> DataFrame:
    """Nearest probe of the same domain per case, by word overlap; the first probe wins ties.

    ``cases`` (domain, query, ...), ``probes`` (domain, pos, question). Probe questions are
    configuration and few: up to a bound they are sent to the tasks, which keep the cases
    where they are. A longer list is compared piece by piece inside the row of the case.
    """
    if is_bounded(probes):
        anchors = probes.select("domain", "pos", "question", text.word_set(F.col("question")).alias("words")).toPandas()
        asked = cases.withColumn("words", text.word_set(F.col("query")))
        return _covered(nearest_by_words(asked, anchors, "domain").withColumn("best_score", F.round("best_score", 4)), threshold)
    return _covered(_best_in_lists(cases, probes), threshold)


def _best_in_lists(cases: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes as lists of at most 256 per domain; only the best of each list is kept per case."""
    item = F.struct("pos", "question", text.word_set(F.col("question")).alias("words"))
    lists = probes.groupBy("domain", F.floor(F.col("pos") / PROBE_CHUNK).alias("_chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("_probes")
    )
    asked = cases.select("domain", "query").distinct().withColumn("_words", text.word_set(F.col("query")))
    compared = F.transform(
        "_probes",
        lambda p: F.struct(
            text.set_jaccard(F.col("_words"), p["words"]).alias("score"), (-p["pos"]).alias("order"), p["question"].alias("question")
        ),
    )
    best = (
        asked.join(lists, "domain")
        .withColumn("_best", F.array_max(compared))
        .groupBy("domain", "query")
        .agg(F.max("_best").alias("_best"))
        .select("domain", "query", F.col("_best.question").alias("best_probe"), F.round("_best.score", 4).alias("best_score"))
    )
    return cases.join(best, ["domain", "query"], "left")


def _covered(cases: DataFrame, threshold: float) -> DataFrame:
    score = F.coalesce("best_score", F.lit(0.0))
    return cases.withColumn("best_score", score).withColumn("covered", F.col("best_score") >= threshold)


def coverage_report(domains: DataFrame, cases: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes, cases, covered cases, gaps and percentage per domain; an empty domain gives zeros."""
    counted = cases.groupBy("domain").agg(F.count("*").alias("_cases"), F.count_if("covered").alias("_covered"))
    asked = probes.groupBy("domain").agg(F.count("*").alias("_probes"))
    joined = domains.select("domain").join(counted, "domain", "left").join(asked, "domain", "left")
    return joined.select(
        "domain",
        F.coalesce("_probes", F.lit(0)).alias("total_probes"),
        F.coalesce("_cases", F.lit(0)).alias("total_edge_cases"),
        F.coalesce("_covered", F.lit(0)).alias("covered_count"),
    ).select(
        "*",
        (F.col("total_edge_cases") - F.col("covered_count")).alias("uncovered_count"),
        ratio(F.col("covered_count") * 100.0, F.col("total_edge_cases"), 1).alias("coverage_pct"),
    )


def entity_coverage(cases: DataFrame) -> DataFrame:
    """Is every case of the entity covered?"""
    return cases.groupBy("domain", "entity").agg(
        F.bool_and("covered").alias("fully_covered"), F.count_if(~F.col("covered")).alias("gaps")
    )


def suggest_probes(gaps: DataFrame) -> DataFrame:
    """A question that would close each gap."""
    kind, e = F.col("case_type"), F.col("entity")
    wording = (
        F.when(kind == "exact_value", F.concat(F.lit("What is the current "), e, F.lit(" value?")))
        .when(kind == "tier", F.concat(F.lit("What tier or classification does "), e, F.lit(" belong to?")))
        .when(kind == "auth", F.concat(F.lit("Does "), e, F.lit(" require any prior authorization or approval?")))
        .when(kind == "comparison", F.concat(F.lit("How does "), e, F.lit(" differ from similar items in the same domain?")))
        .when(kind == "expiry", F.concat(F.lit("When is "), e, F.lit("'s current value scheduled to change or expire?")))
        .when(kind == "boundary", F.concat(F.lit("What boundary or threshold defines "), e, F.lit("?")))
        .when(
            kind == "stale_belief",
            F.concat(F.lit("Has "), e, F.lit("'s value been updated recently — what is the current figure?")),
        )
        .otherwise(F.concat(F.lit("What should I know about "), e, F.lit("?")))
    )
    return gaps.withColumn("suggested_probe", wording)


def gap_ranking(cases: DataFrame, n: int | None = C.TOP_GAPS) -> DataFrame:
    """Gaps of the entities with most gaps first, then the lowest score; all of them without n."""
    gaps = cases.filter(~F.col("covered"))
    counts = gaps.groupBy("entity").agg(F.count("*").alias("entity_gaps"))
    ranked = suggest_probes(gaps.join(counts, "entity")).orderBy(F.desc("entity_gaps"), "best_score", "domain", "entity", "case_type")
    return ranked if n is None else ranked.limit(n)


def coverage_overall(reports: DataFrame) -> DataFrame:
    """Covered share of all cases, one row."""
    sums = reports.agg(F.sum("covered_count").alias("covered"), F.sum("total_edge_cases").alias("cases"))
    return sums.withColumn("coverage_pct", ratio(F.col("covered") * 100.0, F.col("cases"), 1))
