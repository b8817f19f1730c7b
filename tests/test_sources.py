"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from veralytics.operators import events as E
from veralytics.sources import profiles as P
from veralytics.sources import merge, readers, schemas, sinks


def test_event_log_drops_bad_lines(spark, tmp_path):
    good = {"event_id": "1", "timestamp": "2024-01-01T02:00:00+02:00", "source_module": "DKSM", "event_type": "EXPIRY_ALERT", "domain": "d", "entity": None, "payload": {"a": {"b": 1}}, "severity": "CRITICAL", "requires_approval": True}
    lines = [json.dumps(good), "", "{broken", json.dumps({**good, "timestamp": "no time"}), json.dumps({"event_id": "2"}), json.dumps({**good, "event_id": "3", "timestamp": "2024-01-01T00:00:00"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = readers.event_log_read(spark, str(tmp_path / "log.jsonl")).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == ["1", "3"]
    assert str(rows[0].event_ts) == "2024-01-01 00:00:00" == str(rows[1].event_ts)
    assert json.loads(rows[0].payload) == {"a": {"b": 1}}
    assert readers.event_log_read(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_gold_read(spark, tmp_path):
    (tmp_path / "coupons.csv").write_text("coupon_code,max_savings_usd,version,is_current,note\nA,5,1,true,hello\nB,,2,false,\n")
    gold = readers.gold_read_all(spark, str(tmp_path), {"coupons": ("coupon_code", "max_savings_usd"), "missing": ("a", "b")})
    rows = gold.orderBy("entity").collect()
    assert [(r.domain, r.entity, r.value, r.version, r.is_current) for r in rows] == [("coupons", "A", "5", "1", "true"), ("coupons", "B", None, "2", "false")]
    assert rows[0].attrs == {"note": "hello"} and gold.schema.simpleString() == spark.createDataFrame([], schemas.GOLD).schema.simpleString()


def test_run_results(spark, tmp_path):
    artifact = {
        "metadata": {"generated_at": "2024-02-01T10:00:00Z"},
        "results": [
            {"unique_id": "model.p.fct_coupons", "status": "success", "execution_time": 2.5, "adapter_response": {"rows_affected": 7}, "message": "ok"},
            {"unique_id": "model.p.other"}, {"unique_id": "model.p.x_fct_a"},
        ],
    }
    (tmp_path / "run_results.json").write_text(json.dumps(artifact, indent=2))
    models = spark.createDataFrame([("fct_coupons",), ("fct_a",)], "dbt_model string")
    rows = readers.run_results_ingest(spark, str(tmp_path / "run_results.json"), models).orderBy("dbt_model").collect()
    assert [(r.dbt_model, r.run_id, r.domain, r.status, r.rows_affected, r.schema_version) for r in rows] == [
        ("fct_a", ".x_fct_a", "a", "unknown", 0, "dbt-live"), ("fct_coupons", "_coupons", "coupons", "success", 7, "dbt-live"),
    ]


def test_append_fills_missing_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_table(spark.createDataFrame([("q", 1)], "question string, extra int"), path, schemas.CRAG_LOG)
    sinks.append_table(spark.createDataFrame([("r", 0.5)], "question string, confidence double"), path, schemas.CRAG_LOG)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and "extra" not in stored.columns


def test_overwrite_partitions_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.partitionBy("k").parquet(path)
    sinks.overwrite_partitions(spark.createDataFrame([("a", 9)], "k string, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_profiles(spark, tmp_path):
    profile = {
        "company": {"id": "acme", "display_name": "Acme"},
        "domains": {
            "rates": {"display_name": "Rates", "probe_schedule": "daily", "staleness_thresholds": {"fresh": 0.9, "stale": 0.7, "critical": 0.5}, "business_impact": {"wrong_avg_cost_usd": 520, "decisions_per_month": 18000}},
            "plans": {},
        },
    }
    (tmp_path / "acme.json").write_text(json.dumps(profile))
    flat = readers.profiles_read(spark, str(tmp_path))
    rows = {r.domain: r for r in P.company_domains(flat).collect()}
    assert rows["acme__rates"].cost_usd == 520.0 and rows["acme__rates"].decisions_per_month == 18000
    assert rows["acme__plans"].probe_schedule == "manual"
    labels = {r.domain_key: r.label for r in P.domain_label(flat).collect()}
    assert labels == {"acme__rates": "Acme — Rates", "acme__plans": "Acme — plans"}


def test_yaml_profiles(spark):
    text = "company:\n  id: a\ndomains:\n  d:\n    probe_schedule: hourly\n"
    try:
        rows = readers.profiles_from_yaml(spark, [text]).collect()
    except RuntimeError:
        return
    assert [(r.company_id, r.domain_key, r.probe_schedule) for r in rows] == [("a", "d", "hourly")]


def test_session_zone_does_not_matter(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(
        '{"event_id":"1","timestamp":"2024-03-10T02:30:00+00:00","source_module":"PP","event_type":"X","domain":"d","payload":{}}'
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = readers.event_log_read(spark, str(tmp_path)).select(F.col("event_ts").cast("string")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row[0] == "2024-03-10 02:30:00"


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = tmp_path / "index"
    docs = spark.range(200).select(
        F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "gold").otherwise("bronze").alias("layer"),
        F.concat(F.lit("dom"), F.col("id") % 3).alias("domain"), F.concat(F.lit("e"), F.col("id") % 5).alias("entity"),
        F.lit(1.0).alias("boost"), F.lit(None).cast("timestamp_ntz").alias("boosted_at"), F.lit("old").alias("text"),
    )
    merge.rebuild_index(docs, str(path))
    probe = docs.limit(1).withColumns({"doc_id": F.lit("p"), "layer": F.lit("probe_history"), "at": F.lit(1)})
    assert merge.upsert_index(probe, str(path), "at") == 1
    before = _files(path)
    rows = [("d0", "first", 1), ("d0", "last", 2), ("new", "added", 1)]
    incoming = spark.createDataFrame(rows, "doc_id string, text string, at int").withColumns(
        {"layer": F.lit("gold"), "domain": F.lit("dom0"), "entity": F.lit("e0"), "boost": F.lit(1.0), "boosted_at": F.lit(None).cast("timestamp_ntz")}
    )
    n = merge.upsert_index(incoming, str(path), "at")
    after = _files(path)
    changed = {f.rsplit("/", 1)[0] for f in before.keys() ^ after.keys()}
    assert 1 <= n <= 2 and len(changed) == n and all(f.startswith("layer=gold/domain=dom0/") for f in changed)
    assert all(after[f] == t for f, t in before.items() if f.rsplit("/", 1)[0] not in changed)
    table = spark.read.parquet(str(path))
    assert table.count() == 202
    assert {r.doc_id: r.text for r in table.where("text <> 'old'").collect()} == {"d0": "last", "new": "added"}
    # A boost touches gold alone; without a hit nothing is written.
    corrections = spark.createDataFrame([("dom1", "e4")], "domain string, entity string")
    before = _files(path)
    assert merge.boost_index(corrections, str(path), "2024-01-01 00:00:00") > 0
    assert all(f.startswith("layer=gold/domain=dom1/") for f in before.keys() ^ _files(path).keys())
    assert merge.boost_index(corrections.withColumn("entity", F.lit("none")), str(path), "2024-01-01 00:00:00") == 0
    assert {tuple(r) for r in spark.read.parquet(str(path)).where("boost > 1").select("layer", "domain", "entity").distinct().collect()} == {("gold", "dom1", "e4")}
    # A rebuild keeps the probe history and drops what is no longer there.
    merge.rebuild_index(docs.where("layer = 'gold' AND domain <> 'dom2'"), str(path))
    assert {tuple(r) for r in spark.read.parquet(str(path)).select("layer", "domain").distinct().collect()} == {("gold", "dom0"), ("gold", "dom1"), ("probe_history", "dom0")}


def test_fact_and_outcome_tables_are_changed_in_place(spark, tmp_path):
    gold, outcomes = str(tmp_path / "gold"), str(tmp_path / "outcomes")
    facts = [("a", f"e{i}", str(i), False, None) for i in range(30)] + [("b", "e1", "1", False, None)]
    merge.write_rows(spark.createDataFrame(facts, "domain string, entity string, value string, fle_flagged boolean, fle_correct_value string"), gold, "entity")
    names = "signal_id string, domain string, entity string, routing_action string, correct_value string, applied boolean, signal_ts string"
    signals = [("1", "a", "e3", "flag_gold_and_reprobe", "33", True, "1"), ("2", "a", "e3", "flag_gold_and_reprobe", "34", True, "2"), ("3", "c", "e3", "flag_gold_and_reprobe", "9", True, "1")]
    before = _files(tmp_path / "gold")
    assert merge.flag_gold_table(spark.createDataFrame(signals, names), gold) == 1
    assert len({f.rsplit("/", 1)[0] for f in before.keys() ^ _files(tmp_path / "gold").keys()}) == 1
    assert [(r.domain, r.entity, r.fle_correct_value) for r in spark.read.parquet(gold).where("fle_flagged").collect()] == [("a", "e3", "34")]
    assert spark.read.parquet(gold).count() == 31
    rows = [(i, "ab"[i % 2], i % 4 == 0) for i in range(40)]
    merge.write_rows(spark.createDataFrame(rows, "outcome_id long, domain string, correction_applied boolean"), outcomes, "outcome_id")
    injections = spark.createDataFrame([("a",)], "domain string")
    assert merge.tag_injection_table(injections, outcomes) > 0 and merge.tag_injection_table(injections, outcomes) == 0
    assert {(r.outcome_id, r.correction_applied) for r in spark.read.parquet(outcomes).collect()} == {(i, c or d == "a") for i, d, c in rows}


def test_time_filters_prune_the_log(spark, tmp_path):
    """The log is stored by day: a time filter reads only the days it needs."""
    path = str(tmp_path / "log")
    rows = [(str(i), f"2024-01-{1 + i % 20:02d} {i % 24:02d}:30:00", "DKSM", "EXPIRY_ALERT", "d", f"e{i % 3}", "{}", "INFO", False) for i in range(200)]
    names = "event_id string, event_ts string, source_module string, event_type string, domain string, entity string, payload string, severity string, requires_approval boolean"
    events = spark.createDataFrame(rows, names).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    sinks.event_log_append(events, path)
    log = spark.read.parquet(path)
    as_of, start = "2024-01-05 12:00:00", "2024-01-04 12:00:00"
    asked = [
        (E.get_chain(log, as_of, "d", "e1", hours=24), lambda r: r[1] >= start and r[5] == "e1"),
        (E.replay(log, start, as_of), lambda r: start <= r[1] <= as_of),
        (E.recent(log, as_of, 24, "DKSM"), lambda r: r[1] >= start),
    ]
    for df, keeps in asked:
        assert "PartitionFilters: [isnotnull(event_date" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.event_id for r in df.collect()) == sorted(r[0] for r in rows if keeps(r))
