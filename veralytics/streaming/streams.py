"""Structured Streaming jobs over the event log, injections and outcomes.

Event times are plain UTC times; watermarks need instants, so a stream carries
``event_time`` next to ``event_ts``. Late rows are dropped by the watermark and show in
the query's progress (``late_rows``).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veralytics import config as C
from veralytics.functions import clock
from veralytics.operators.events import critical_escalation, industry_of, queue_for_approval
from veralytics.operators.medallion import gold_current
from veralytics.operators.schedule import digest_subject, notify_filter

# The state function of this module travels to the tasks by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "1 hour"
LINK_SALT = 16


def timed(stream: DataFrame, ts: str = "event_ts", watermark: str = WATERMARK) -> DataFrame:
    """Add the watermarked ``event_time`` instant."""
    return stream.withColumn("event_time", clock.to_instant(F.col(ts))).withWatermark("event_time", watermark)


def readiness_stream(events: DataFrame, gold: DataFrame, ttl_hours: int = C.INJECTION_TTL_HOURS) -> DataFrame:
    """Stream–static join: every staleness event of a current fact becomes a pending row."""
    facts = gold_current(gold).groupBy("domain", "entity").agg(
        F.max_by(F.struct("value", "version"), F.struct(F.coalesce("version", F.lit(0)), "value")).alias("_g")
    )
    return (
        events.filter(F.col("event_type") == "STALENESS_DETECTED")
        .join(facts, ["domain", "entity"])
        .select(
            "domain",
            "entity",
            F.col("_g.value").alias("value"),
            F.concat(F.lit("v"), F.coalesce(F.col("_g.version").cast("string"), F.lit("current"))).alias("version"),
            F.col("event_ts").alias("ready_at"),
            (F.col("event_ts") + clock.hours(ttl_hours)).alias("expires"),
        )
    )


# Times of the state are microseconds, timers and watermarks are milliseconds.
HOUR_US = 3_600_000_000
# Keys are dealt to so many groups of state; a call of Python serves the keys of a group, not one key.
PENDING_GROUPS = 1 << 14
PENDING_ROW = "domain string, entity string, ready_us bigint, value string, version string"
PENDING_STATE = "pending array<struct<domain: string, entity: string, ready_us: bigint, value: string, version: string>>"
_PENDING = "domain string, entity string, value string, version string, ready_at timestamp, status string"


def _grouped(ready: DataFrame, watermark: str, groups: int) -> DataFrame:
    source = timed(ready, "ready_at", watermark).select("domain", "entity", "value", "version", "event_time")
    return source.withColumn("_group", F.pmod(F.xxhash64("domain", "entity"), F.lit(groups)).cast("int"))


def pending_stream(
    ready: DataFrame, ttl_hours: int = C.INJECTION_TTL_HOURS, watermark: str = WATERMARK, groups: int = PENDING_GROUPS
) -> DataFrame:
    """Keyed state with a time-to-live: the latest pending row per (domain, entity).

    A newer row replaces the older one and is emitted as ``active``; when the watermark
    passes its expiry the key is dropped and emitted as ``expired``, also when a late
    row of the key comes in the batch that would have ended it. Keys share a state row by
    hash, ``groups`` of them in all; a group wakes when the first of its keys ends.
    """
    ttl_us = ttl_hours * HOUR_US

    def step(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _by_key(state.get[0]) if state.exists else {}
        out = _settle(held, {} if state.hasTimedOut else _newest(batches), ttl_us, state.getCurrentWatermarkMs())
        if out and held:
            state.update(([(*key, *row) for key, row in held.items()],))
        elif out and state.exists:
            state.remove()
        if held:
            state.setTimeoutTimestamp(_first_end(held, ttl_us))
        if out:
            yield _pending_rows(out)

    out = _grouped(ready, watermark, groups).groupBy("_group").applyInPandasWithState(
        step, _PENDING, PENDING_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    return out.withColumn("ready_at", clock.from_instant(F.col("ready_at")))


class PendingProcessor(StatefulProcessor):
    """The newest pending rows of a group's keys as a list, their first end as an event-time timer."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING_ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = _by_key(self.pending.get())
        first = _first_end(held, self.ttl_us)
        out = _settle(held, _newest(rows), self.ttl_us, timerValues.getCurrentWatermarkInMs())
        if out:
            yield self._keep(held, first, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = _by_key(self.pending.get())
        out = _settle(held, {}, self.ttl_us, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1))
        if out:
            yield self._keep(held, None, out)

    def _keep(self, held: dict, timer: int | None, out: list[tuple]) -> pd.DataFrame:
        """Store what is left and move the timer to its first end."""
        self.pending.put([(*key, *row) for key, row in held.items()]) if held else self.pending.clear()
        first = _first_end(held, self.ttl_us)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        return _pending_rows(out)

    def close(self) -> None:
        pass


def pending_state(
    ready: DataFrame, ttl_hours: int = C.INJECTION_TTL_HOURS, watermark: str = WATERMARK, groups: int = PENDING_GROUPS
) -> DataFrame:
    """As :func:`pending_stream`, with the pending rows and their timer kept apart, so that the state is a table.

    Needs the RocksDB state store (``ROCKS``). :func:`pending_table` reads the state of a
    stopped or running query.
    """
    out = _grouped(ready, watermark, groups).groupBy("_group").transformWithStateInPandas(
        PendingProcessor(ttl_hours * HOUR_US), _PENDING, "Update", "EventTime"
    )
    return out.withColumn("ready_at", clock.from_instant(F.col("ready_at")))


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pending_table(spark: SparkSession, checkpoint: str, ttl_hours: int = C.INJECTION_TTL_HOURS) -> DataFrame:
    """The keys that are pending now, read from the state of a :func:`pending_state` query: one row per key.

    The state store is read in as many parts as the query has state partitions; the stream
    need not run and is not touched.
    """
    state = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    rows = state.select("list_element.*")
    ready = clock.from_instant(F.timestamp_micros("ready_us"))
    return rows.select("domain", "entity", "value", "version", ready.alias("ready_at")).withColumn(
        "expires", F.col("ready_at") + clock.hours(ttl_hours)
    )


def _micros(times: pd.Series) -> pd.Series:
    return times.dt.as_unit("us").astype("int64")


def _end_ms(ready_us: int, ttl_us: int) -> int:
    """The first whole millisecond at which a row's time to live is over."""
    return -(-(ready_us + ttl_us) // 1000)


def _newness(row: tuple) -> tuple:
    return row[0], row[1] or "", row[2] or ""


def _by_key(rows) -> dict[tuple, tuple]:
    return {(domain, entity): (us, value, version) for domain, entity, us, value, version in rows}


def _newest(batches: Iterator[pd.DataFrame]) -> dict[tuple, tuple]:
    """The newest row of each key of a group, as (microseconds, value, version)."""
    found: dict[tuple, tuple] = {}
    for batch in batches:
        domain, entity, value, version = ([v if isinstance(v, str) else None for v in batch[c].tolist()] for c in ("domain", "entity", "value", "version"))
        for key, row in zip(zip(domain, entity), zip(_micros(batch["event_time"]).tolist(), value, version)):
            if key not in found or _newness(row) > _newness(found[key]):
                found[key] = row
    return found


def _settle(held: dict[tuple, tuple], found: dict[tuple, tuple], ttl_us: int, watermark: int) -> list[tuple]:
    """Bring ``held`` up to date with the newest rows and the watermark; what came and went, as (key, row, status)."""
    out = []
    for key, new in found.items():
        old = held.get(key)
        best = new if old is None or _newness(new) > _newness(old) else old
        if _end_ms(best[0], ttl_us) <= watermark:  # also a held row that the watermark has passed in the meantime
            held.pop(key, None)
            out.append((key, best, "expired"))
        elif best != old:
            held[key] = best
            out.append((key, best, "active"))
    for key in [key for key, row in held.items() if _end_ms(row[0], ttl_us) < watermark]:
        out.append((key, held.pop(key), "expired"))
    return out


def _first_end(held: dict[tuple, tuple], ttl_us: int) -> int | None:
    return _end_ms(min(row[0] for row in held.values()), ttl_us) if held else None


def _pending_rows(out: list[tuple]) -> pd.DataFrame:
    keys, rows, status = zip(*out)
    return pd.DataFrame(
        {
            "domain": [k[0] for k in keys], "entity": [k[1] for k in keys], "value": [r[1] for r in rows],
            "version": [r[2] for r in rows], "ready_at": np.array([r[0] for r in rows], "datetime64[us]"), "status": status,
        }
    )


# (domain, slot) pairs that a task of the link holds before it passes them on.
SLOT_GROUPS = 100_000


def slot_ends(injections: DataFrame, slot_us: int) -> DataFrame:
    """First and last injection of each (domain, slot) that a task reads, as far as it held them together."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ends = rows.group_by(["domain", "_slot"]).aggregate([("_first", "min"), ("_last", "max")])
            held = ends.select(["domain", "_slot", "_first_min", "_last_max"]).rename_columns(["domain", "_slot", "_first", "_last"])
            if held.num_rows >= SLOT_GROUPS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    at = F.col("injected_at")
    rows = injections.where(F.col("domain").isNotNull() & at.isNotNull()).select(
        "domain", clock.floor_div(clock.epoch_micros(at), slot_us).alias("_slot"), at.alias("_first"), at.alias("_last")
    )
    return rows.mapInArrow(reduce, rows.schema)


def link_stream(injections: DataFrame, outcomes: DataFrame, hours: int = C.LINK_HOURS, salt: int = LINK_SALT) -> DataFrame:
    """Stream–stream semi join: each outcome once if an injection of its domain precedes it closely enough.

    Time is cut into slots as long as the window, so an outcome meets only injections of
    its own slot, where the first decides, and of the slot before, where the last decides;
    tasks pass on no others. Few domains would mean few busy state partitions, so outcomes
    are spread over ``salt`` parts and those ends are copied to each. A slot's injections
    are late only when its last one is, so an early one beside it still counts.
    """
    slot_us = max(int(hours) * HOUR_US, 1)
    slot = clock.floor_div(clock.epoch_micros(F.col("outcome_ts")), slot_us)
    left = timed(outcomes, "outcome_ts").withColumns(
        {"_part": F.pmod(F.xxhash64("outcome_id"), F.lit(salt)).cast("int"), "_slot": slot}
    )
    right = timed(slot_ends(injections, slot_us), "_last").select(
        F.col("domain").alias("_domain"), clock.to_instant(F.col("_first")).alias("_first"), F.col("event_time").alias("_injected"),
        F.col("_slot").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_part_of"),
    )
    right = right.select("*", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_meets"))
    # The outer bounds hold for every link; they tell Spark how long a row must be kept.
    window = F.expr(
        f"""event_time >= _injected - INTERVAL {int(hours)} HOURS AND event_time <= _injected + INTERVAL {int(hours)} HOURS
        AND event_time >= _first AND (_meets = _own OR event_time >= _injected)"""
    )
    keys = (F.col("domain") == F.col("_domain")) & (F.col("_part") == F.col("_part_of")) & (F.col("_slot") == F.col("_meets"))
    return left.join(right, keys & window, "left_semi").drop("_part", "_slot", "event_time")


def digest_stream(events: DataFrame, industries: DataFrame, hours: int = C.DIGEST_HOURS) -> DataFrame:
    """Tumbling-window digest counts per industry."""
    placed = timed(industry_of(notify_filter(events), industries))
    counts = placed.groupBy(F.window("event_time", f"{hours} hours").alias("_w"), "industry").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("severity") == "CRITICAL").alias("criticals"),
        F.count_if(F.col("event_type") == "EXPIRY_ALERT").alias("expiries"),
    )
    return digest_subject(
        counts.select(clock.from_instant(F.col("_w.start")).alias("window_start"), "industry", "events", "criticals", "expiries")
    )


# Which derived table each event type feeds.
SUBSCRIBERS = {
    "injection": ("STALENESS_DETECTED",),
    "root_cause": ("STALENESS_DETECTED",),
    "value": ("CONTEXT_INJECTED", "PIPELINE_FAILURE_FOUND", "CORRECTION_APPLIED"),
    "feedback": ("CONTEXT_INJECTED", "CORRECTION_RECEIVED"),
    "governance": ("VALUE_CALCULATED",),
    "reprobe": ("REPROBE_REQUESTED",),
    "notification": C.NOTIFY_TYPES,
}


def route_events(
    events: DataFrame, folder: str, handlers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, late_after: str = WATERMARK
) -> StreamingQuery:
    """Fan events out to one table per subscriber and to the approval queue, each event id once for all time.

    The ids that were routed are stored (``ids``), so a repeat is known however late it
    comes, and no state is held for it. A first event that lies more than ``late_after``
    behind the newest event of earlier batches is routed like any other and also kept in
    ``late``, with the time by which it is late. Of repeats inside a batch the smallest
    row stands. Each batch writes its own folders and writes them again in full when it is
    repeated, so a lost executor or a restart leaves no duplicates. ``handlers`` may
    transform what a subscriber stores.
    """
    spark = events.sparkSession
    flagged = critical_escalation(events)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = _first_of_each(batch, _earlier(spark, f"{folder}/ids", "event_id string, event_ts timestamp_ntz", batch_id))
        fresh.write.mode("overwrite").parquet(f"{folder}/fresh/batch={batch_id}")
        fresh = spark.read.schema(fresh.schema).parquet(f"{folder}/fresh/batch={batch_id}")
        for name, kinds in SUBSCRIBERS.items():
            rows = fresh.filter(F.col("event_type").isin(*kinds))
            rows = handlers[name](rows) if handlers and name in handlers else rows
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        queue_for_approval(fresh).write.mode("overwrite").parquet(f"{folder}/approvals/batch={batch_id}")
        newest = _earlier(spark, f"{folder}/newest", "newest timestamp_ntz", batch_id).agg(F.max("newest").alias("_newest"))
        behind = F.expr(f"_newest - INTERVAL {late_after}")
        late = fresh.join(newest, F.col("event_ts") < behind).withColumn("late_by", F.col("_newest") - F.col("event_ts")).drop("_newest")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        fresh.agg(F.max("event_ts").alias("newest")).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")
        fresh.select("event_id", "event_ts").write.mode("overwrite").parquet(f"{folder}/ids/batch={batch_id}")

    return (
        flagged.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    )


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What the batches before this one stored; a folder that is not there yet is empty."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch bigint").option("ignoreMissingFiles", True).parquet(path)
    return stored.filter(F.col("batch") < batch_id).drop("batch")


def _first_of_each(batch: DataFrame, routed: DataFrame) -> DataFrame:
    """One row per event id that was not routed before.

    The stored ids are reduced to those of the batch first: they are many, the batch is
    not, so Spark may send the batch's ids to them and need not move them. Events without
    an id are all kept.
    """
    row = F.struct(*[F.col(c) for c in batch.columns])
    one = batch.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min(row).alias("_row")).select("_row.*")
    known = routed.select("event_id").join(one.select("event_id"), "event_id", "left_semi")
    return one.join(known, "event_id", "left_anti").select(*batch.columns).union(batch.filter("event_id IS NULL"))


def event_log_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the log table, one folder per day."""
    dated = events.withColumn("event_date", F.col("event_ts").cast("date"))
    return (
        dated.writeStream.format("parquet").partitionBy("event_date").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is; every batch is one folder of the result, with its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/data")


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has dropped so far."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream over the parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
