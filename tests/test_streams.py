"""State over several batches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veralytics.operators import events as E
from veralytics.sources import readers
from veralytics.streaming import streams as Z


def write_log(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"event_id": i, "timestamp": ts, "source_module": "DKSM", "event_type": kind, "domain": "d", "entity": e, "payload": {}, "severity": sev, "requires_approval": False})
        for i, ts, kind, e, sev in rows
    ]
    (folder / name).write_text("\n".join(lines))


def test_pending_state_replaces_and_expires(spark, tmp_path):
    log = tmp_path / "log"
    write_log(log, "1.jsonl", [("1", "2024-01-01T00:00:00", "STALENESS_DETECTED", "a", "INFO"), ("2", "2024-01-01T00:10:00", "STALENESS_DETECTED", "b", "INFO")])
    gold = spark.createDataFrame([("d", "a", "5", 1, "true"), ("d", "b", "6", 1, "true")], "domain string, entity string, value string, version int, is_current string")
    events = readers.event_log_stream(spark, str(log))
    stream = Z.pending_stream(Z.readiness_stream(events, gold))
    out = str(tmp_path / "out")
    Z.run_available(stream, out, "update")
    # b again within its time to live, then a far later event that moves the watermark past both.
    write_log(log, "2.jsonl", [("3", "2024-01-01T02:00:00", "STALENESS_DETECTED", "b", "INFO")])
    Z.run_available(stream, out, "update")
    write_log(log, "3.jsonl", [("4", "2024-01-01T05:30:00", "STALENESS_DETECTED", "a", "INFO")])
    Z.run_available(stream, out, "update")
    write_log(log, "4.jsonl", [("5", "2024-01-01T05:40:00", "STALENESS_DETECTED", "a", "INFO")])
    rows = Z.run_available(stream, out, "update").orderBy("batch", "entity").collect()
    seen = [(r.entity, str(r.ready_at), r.status) for r in rows]
    assert ("b", "2024-01-01 02:00:00", "active") in seen
    assert ("a", "2024-01-01 05:30:00", "active") in seen and ("a", "2024-01-01 05:40:00", "active") in seen
    assert ("b", "2024-01-01 00:10:00", "expired") not in seen


def test_late_row_of_a_key_whose_time_has_passed(spark, tmp_path):
    """One file per batch: the third row comes after the watermark has passed the held row's end."""
    log = tmp_path / "log"
    gold = spark.createDataFrame([("d", "a", "5", 1, "true"), ("d", "b", "6", 1, "true")], "domain string, entity string, value string, version int, is_current string")
    out = str(tmp_path / "out")
    for i, (entity, ts) in enumerate([("a", "03:00"), ("b", "12:00"), ("a", "02:30")]):
        write_log(log, f"{i}.jsonl", [(str(i), f"2024-01-01T{ts}:00", "STALENESS_DETECTED", entity, "INFO")])
        stream = Z.pending_stream(Z.readiness_stream(readers.event_log_stream(spark, str(log)), gold))
        rows = Z.run_available(stream, out, "update").collect()
    seen = [(r.entity, str(r.ready_at), r.status) for r in rows]
    assert seen.count(("a", "2024-01-01 03:00:00", "expired")) == 1 and ("b", "2024-01-01 12:00:00", "active") in seen


def test_routing_drops_repeats_and_survives_restart(spark, tmp_path):
    log = tmp_path / "log"
    write_log(log, "1.jsonl", [("1", "2024-01-01T00:00:00", "STALENESS_DETECTED", "a", "CRITICAL"), ("1", "2024-01-01T00:00:00", "STALENESS_DETECTED", "a", "CRITICAL")])
    out = str(tmp_path / "out")
    Z.route_events(readers.event_log_stream(spark, str(log)), out).awaitTermination()
    write_log(log, "2.jsonl", [("2", "2024-01-01T00:01:00", "APPROVAL_REQUIRED", "b", "INFO"), ("1", "2024-01-01T00:00:00", "STALENESS_DETECTED", "a", "CRITICAL")])
    Z.route_events(readers.event_log_stream(spark, str(log)), out).awaitTermination()
    assert spark.read.parquet(f"{out}/injection").count() == 1
    assert sorted(r.request_id for r in spark.read.parquet(f"{out}/approvals").collect()) == ["REQ-1", "REQ-2"]


def test_a_repeat_hours_late_is_known_and_a_late_first_event_is_kept(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    first = ("1", "2024-01-01T00:00:00", "STALENESS_DETECTED", "a", "CRITICAL")
    again = ("1", "2024-01-01T03:10:00", "STALENESS_DETECTED", "a", "CRITICAL")  # the same id with another time
    batches = [
        [first], [("2", "2024-01-01T03:00:00", "APPROVAL_REQUIRED", "b", "INFO")],
        [first, again, ("3", "2024-01-01T01:00:00", "STALENESS_DETECTED", "c", "INFO"), ("4", "2024-01-01T02:00:00", "EXPIRY_ALERT", "c", "INFO")],
    ]
    for i, rows in enumerate(batches):
        write_log(log, f"{i}.jsonl", rows)
        Z.route_events(readers.event_log_stream(spark, str(log)), out).awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(f"{out}/approvals").collect()) == ["REQ-1", "REQ-2"]
    routed = spark.read.parquet(f"{out}/injection").orderBy("event_id").collect()
    assert [(r.event_id, str(r.event_ts), r.entity, r.requires_approval) for r in routed] == [
        ("1", "2024-01-01 00:00:00", "a", True), ("3", "2024-01-01 01:00:00", "c", False)
    ]
    late = spark.read.parquet(f"{out}/late").collect()
    assert [(r.event_id, r.late_by.total_seconds()) for r in late] == [("3", 7200.0)]
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/ids").collect()) == ["1", "2", "3", "4"]


def test_pending_state_is_a_table(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    gold = spark.createDataFrame([("d", "a", "5", 1, "true"), ("d", "b", None, 1, "true")], "domain string, entity string, value string, version int, is_current string")
    tables = []
    for i, (entity, ts) in enumerate([("a", "00:00:00.000250"), ("b", "00:10:00"), ("b", "02:00:00"), ("a", "05:10:00"), ("b", "01:00:00")]):
        write_log(log, f"{i}.jsonl", [(str(i), f"2024-01-01T{ts}", "STALENESS_DETECTED", entity, "INFO")])
        with Z.rocks_state(spark):
            stream = Z.pending_state(Z.readiness_stream(readers.event_log_stream(spark, str(log)), gold))
            rows = Z.run_available(stream, out, "update").orderBy("batch", "ready_at").collect()
        found = Z.pending_table(spark, f"{out}/_checkpoint").orderBy("entity").collect()
        tables.append([(r.entity, r.value, str(r.ready_at)[11:], str(r.expires)[11:]) for r in found])
    assert tables[0] == [("a", "5", "00:00:00.000250", "04:00:00.000250")]
    assert tables[2] == [("a", "5", "00:00:00.000250", "04:00:00.000250"), ("b", None, "02:00:00", "06:00:00")]
    assert tables[3] == tables[4] == [("a", "5", "05:10:00", "09:10:00"), ("b", None, "02:00:00", "06:00:00")]
    seen = [(r.entity, str(r.ready_at)[11:], r.status) for r in rows]
    assert seen.count(("b", "00:10:00", "expired")) == 0 and ("b", "02:00:00", "active") in seen


@pytest.mark.parametrize("kind", ["stream", "state"])
def test_keys_share_a_group_and_end_one_by_one(spark, tmp_path, kind):
    """Forty keys in two groups: each has its own newest row, its own end and its own row of the table."""
    log, out = tmp_path / "log", str(tmp_path / "out")
    gold = spark.createDataFrame([("d", f"k{i}", None if i % 5 == 0 else str(i), 1, "true") for i in range(40)], "domain string, entity string, value string, version int, is_current string")
    # Every key, then a third of them again, then one key so late that the watermark (01:30 + 4 h) passes the others' first rows up to 01:30.
    batches = [
        [(f"k{i}", f"0{i % 4}:{i:02}:00") for i in range(40)], [(f"k{i}", "04:30:00") for i in range(0, 40, 3)] + [("k4", "00:01:00")], [("k39", "06:30:00")],
    ]
    newest, active, expired = {}, set(), set()
    for i, rows in enumerate(batches):
        write_log(log, f"{i}.jsonl", [(f"{i}-{e}-{ts}", f"2024-01-01T{ts}", "STALENESS_DETECTED", e, "INFO") for e, ts in rows])
        for e, ts in rows:
            if ts > newest.get(e, ""):
                newest[e] = ts
                active.add((e, ts))
        with Z.rocks_state(spark):
            make = Z.pending_stream if kind == "stream" else Z.pending_state
            stream = make(Z.readiness_stream(readers.event_log_stream(spark, str(log)), gold), groups=2)
            found = Z.run_available(stream, out, "update").collect()
    expired = {(e, ts) for e, ts in newest.items() if ts <= "01:30:00"}
    assert 5 < len(expired) < 35
    seen = [(r.entity, str(r.ready_at)[11:], r.status) for r in found]
    assert sorted(seen) == sorted([(*x, "active") for x in active] + [(*x, "expired") for x in expired])
    assert all(r.value == (None if int(r.entity[1:]) % 5 == 0 else r.entity[1:]) for r in found)
    if kind == "state":
        left = sorted((r.entity, str(r.ready_at)[11:]) for r in Z.pending_table(spark, f"{out}/_checkpoint").collect())
        assert left == sorted((e, ts) for e, ts in newest.items() if (e, ts) not in expired)
    else:
        assert spark.read.format("statestore").load(f"{out}/_checkpoint").count() == 2


def test_link_reads_only_the_ends_of_a_slot(spark, tmp_path):
    """Several batches against brute force, times on slot and window ends too; a task passes on two ends per slot."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    moments = lambda n, lo, hi: [start + dt.timedelta(minutes=rng.choice([rng.randint(lo, hi), 60 * rng.randint(lo // 60, hi // 60)]), microseconds=rng.choice([0, 1])) for _ in range(n)]
    inj, out, folder = str(tmp_path / "inj"), str(tmp_path / "out"), str(tmp_path / "run")
    injections, outcomes = [], []
    for lo, hi in ((0, 900), (840, 1700)):
        one = [(rng.choice(["a", "b", "c", None]), t) for t in moments(9, lo, hi)]
        two = [(len(outcomes) + i, rng.choice(["a", "b", "c", "d", None]), t) for i, t in enumerate(moments(120, lo, hi))]
        spark.createDataFrame(one, "domain string, injected_at timestamp_ntz").coalesce(1).write.mode("append").parquet(inj)
        spark.createDataFrame(two, "outcome_id int, domain string, outcome_ts timestamp_ntz").coalesce(1).write.mode("append").parquet(out)
        injections, outcomes = injections + one, outcomes + two
        live = lambda at, schema: spark.readStream.schema(schema).parquet(at)
        linked = Z.link_stream(live(inj, "domain string, injected_at timestamp_ntz"), live(out, "outcome_id int, domain string, outcome_ts timestamp_ntz"), salt=2)
        found = Z.run_available(linked, folder)
    window = dt.timedelta(hours=4)
    expected = sorted(i for i, d, t in outcomes if d is not None and any(d == e and u <= t <= u + window for e, u in injections))
    assert sorted(r.outcome_id for r in found.collect()) == expected and 0 < len(expected) < len(outcomes)
    hot = spark.range(20_000, numPartitions=2).select(F.lit("a").alias("domain"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("injected_at"))
    assert Z.slot_ends(hot, 4 * Z.HOUR_US).count() <= 4


def test_log_sink(spark, tmp_path):
    log = tmp_path / "log"
    write_log(log, "1.jsonl", [("1", "2024-01-01T00:00:00", "EXPIRY_ALERT", "a", "INFO"), ("2", "2024-01-02T00:00:00", "EXPIRY_ALERT", "a", "INFO")])
    Z.event_log_sink(readers.event_log_stream(spark, str(log)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2 and stored.filter(F.col("event_date") == "2024-01-02").count() == 1


def test_approval_chain(spark):
    events = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00", "PP", "APPROVAL_REQUIRED", "d", "e", '{"action":"x"}', "INFO", False)],
        "event_id string, event_ts string, source_module string, event_type string, domain string, entity string, payload string, severity string, requires_approval boolean",
    ).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    queue = E.queue_for_approval(events)
    decisions = spark.createDataFrame([("REQ-1", "rejected", "l1", "2024-01-01"), ("REQ-1", "approved", "l2", "2024-01-02")], "request_id string, decision string, lead string, decided_at string").withColumn(
        "decided_at", F.col("decided_at").cast("timestamp_ntz")
    )
    done = E.decide_approvals(queue, decisions)
    assert [(r.status, r.decided_by, r.reason) for r in done.collect()] == [("approved", "l2", None)]
    assert [r.event_type for r in E.decision_events(done).collect()] == ["APPROVAL_GRANTED"]
    refused = E.decide_approvals(queue, decisions.where("decision = 'rejected'").withColumn("reason", F.lit("too risky")))
    told = E.decision_events(refused).first()
    assert refused.first().reason == "too risky" and told.event_type == "APPROVAL_REJECTED"
    assert json.loads(told.payload) == {"request_id": "REQ-1", "rejected_by": "l1", "reason": "too risky"}
    assert E.decide_approvals(queue, decisions.where("decision = 'rejected'")).first().reason == ""
