"""Hand-computed cases of the rules."""

import pytest
from pyspark.sql import functions as F

from veralytics.functions import clock, text
from veralytics.functions.numbers import extract_number
from veralytics.operators import feedback as B
from veralytics.operators import medallion as M
from veralytics.operators import risk as R
from veralytics.operators import scoring as S
from veralytics.sources.fixtures import Tables


def values(spark, rows, column, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_extract_number(spark):
    rows = [("$1.5M", ""), ("750,000", ""), ("1.2B", ""), ("5%", ""), ("-7", ""), ("5 million", ""), ("none", ""), ("12k of 9", "")]
    got = values(spark, rows, extract_number(F.col("a")))
    assert got == [1.5e6, 750000.0, 1.2e9, 0.05, 7.0, 5e6, None, 12000.0]


def test_days_since_floors(spark):
    rows = [("2024-01-01", ""), ("2024-01-31 13:00:00", ""), ("2024-02-02", ""), ("junk", ""), (None, "")]
    got = values(spark, rows, clock.days_since(F.col("a"), "2024-01-31 12:00:00"))
    assert got == [30, -1, -2, 0, 0]


def test_similarity_and_levels(spark):
    rows = [("6000000", "7500000"), ("Contact support for more", "7500000"), ("été chaud", "Été froid"), ("5", "0")]
    got = values(spark, rows, S.semantic_similarity(F.col("a"), F.col("b")))
    assert got == [0.8, 0.0, pytest.approx(0.3333), 0.0]


def test_score_of_empty_belief_is_unknown(spark):
    domains = spark.createDataFrame([("d", 0.9, 0.7)], "domain string, fresh double, stale double")
    pairs = spark.createDataFrame(
        [("d", "x", "", "5", "2024-01-01"), ("d", "y", "7500000", "7500000", "2024-01-01"), ("other", "z", "prose", "7500000", None)],
        "domain string, entity string, model_belief string, warehouse_truth string, effective_date string",
    )
    got = {r.entity: r for r in S.staleness_score(pairs, domains, "2024-06-29 00:00:00").collect()}
    assert (got["x"].staleness_level, got["x"].staleness_score, got["x"].confidence, got["x"].days_since_update) == ("UNKNOWN", 1.0, 0.1, 0)
    assert (got["y"].staleness_level, got["y"].staleness_score, got["y"].numeric_match) == ("FRESH", 0.0, True)
    assert got["y"].days_since_update == 180
    assert (got["z"].staleness_level, got["z"].staleness_score, got["z"].numeric_match) == ("CRITICAL", 1.0, None)


def test_classify_error(spark):
    rows = [("6000000", "7500000"), ("Enterprise tier", "Enterprise segment"), ("alpha", "beta"), ("", "x"), ("100", "101"), ("nan", "5"), ("1d", "9")]
    got = values(spark, rows, B.classify_error(F.col("a"), F.col("b")))
    assert got == [
        "THRESHOLD_ERROR", "RETRIEVAL_ERROR", "DEFINITION_ERROR", "CLASSIFICATION_ERROR", "DEFINITION_ERROR", "DEFINITION_ERROR", "DEFINITION_ERROR",
    ]


def test_capture_signal_status(spark):
    signals = spark.createDataFrame([("user_correction", 0.95), ("odd", 0.5)], "signal_type string, confidence double")
    got = [tuple(r) for r in B.capture_signal(signals).select("signal_type", "fle_status").collect()]
    assert got == [("user_correction", "classified"), ("user_correction", "pending")]


def test_values_match_and_strip_units(spark):
    rows = [(" Gold. ", "gold"), ("a", "b")]
    assert values(spark, rows, text.values_match(F.col("a"), F.col("b"))) == [True, False]
    rows = [("a.\n", "\ta"), ("\u3000A;\u00a0", "a"), ("a b", "ab")]
    assert values(spark, rows, text.values_match(F.col("a"), F.col("b"))) == [True, True, False]
    assert values(spark, [("\t", ""), (" \n\u00a0", ""), ("\tx", ""), (None, "")], text.blank(F.col("a"))) == [True, True, False, True]
    assert values(spark, [("\t$4.00\nmonth\nx", "")], text.strip_units(F.col("a"))) == ["4.00"]
    assert values(spark, [("$4.00/month", ""), ("125 mg", ""), ("$", "")], text.strip_units(F.col("a"))) == ["4.00", "125", "$"]


def test_gold_current_flags(spark):
    rows = [("true",), ("TRUE",), ("1",), ("yes",), ("no",), (None,)]
    assert M.gold_current(spark.createDataFrame(rows, "is_current string")).count() == 5


def test_crag_walk(spark):
    attempts = spark.createDataFrame(
        [
            (1, 1, "AMBIGUOUS", None), (1, 2, "CORRECT", "7"), (1, 3, "CORRECT", "8"),
            (2, 1, "AMBIGUOUS", None), (2, 2, "AMBIGUOUS", None), (2, 3, "AMBIGUOUS", None), (2, 4, "CORRECT", "9"),
            (3, 1, "INCORRECT", None), (3, 2, "CORRECT", "1"), (4, 1, "AMBIGUOUS", None),
        ],
        "probe_id int, attempt int, grade string, extracted_value string",
    ).withColumns({"confidence": F.lit(0.5), "cost_micros": F.lit(10)})
    context = spark.createDataFrame([(2, "a", "55", 0.4), (2, "b", "66", 0.9)], "probe_id int, entity string, current_value string, similarity_score double")
    got = {r.probe_id: r for r in S.crag_resolve(attempts, context).collect()}
    assert (got[1].extracted_value, got[1].retries_used, got[1].crag_fallback, got[1].cost_micros) == ("7", 1, False, 20)
    assert (got[2].extracted_value, got[2].retries_used, got[2].retries_reported, got[2].crag_fallback) == ("66", 2, 1, True)
    assert (got[3].extracted_value, got[3].retries_used, got[3].fallback_source) == (None, 0, "vector_store")
    assert got[4].crag_fallback and got[4].crag_grade == "AMBIGUOUS"


def test_grades(spark):
    totals = spark.createDataFrame([(99_999.0,), (100_000.0,), (999_999.0,), (1e6,), (5e6,)], "t double")
    assert [r[0] for r in totals.select(R.risk_grade(F.col("t"))).collect()] == ["A", "B", "C", "D", "F"]


def test_invariants(spark, sf_dir):
    from veralytics.plans import coverage, value

    t = Tables(spark, sf_dir)
    for r in value.exposures(t).collect():
        assert 0 <= r.estimated_bad_decisions <= r.total_decisions and r.financial_exposure_usd >= 0
    summary = value.V.value_summary(value.by_domain(t)).first()
    assert summary.net_value_usd <= summary.total_recovered_usd
    report = coverage.V.coverage_report(t.domains, coverage.scored(t), coverage.questions(t)).collect()
    assert all(r.covered_count + r.uncovered_count == r.total_edge_cases and r.coverage_pct <= 100 for r in report)
    loose = coverage.V.best_probe_text(coverage.cases(t), coverage.questions(t), 0.01).filter("covered").count()
    strict = coverage.V.best_probe_text(coverage.cases(t), coverage.questions(t), 0.05).filter("covered").count()
    assert loose >= strict
