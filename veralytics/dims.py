"""Small dimension tables of fixed size, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veralytics import config as C


def fixed(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Fixed rows as a table whose size Spark knows, so that it is broadcast without a hint.

    A table made from Python rows has no known size: joining the event log with it would
    shuffle the whole log.
    """
    fields = T.StructType.fromDDL(schema).fields

    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, list):
            return "array(" + ", ".join(map(literal, value)) + ")"
        return repr(value)

    names = ", ".join(f.name for f in fields)
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def pairs(spark: SparkSession, values: Mapping, key: str, value: str, value_type: str = "string") -> DataFrame:
    """A fixed mapping as a two-column table."""
    return fixed(spark, values.items(), f"{key} string, {value} {value_type}")


def wrong_rates(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.WRONG_RATE, "staleness_level", "base_rate", "double")


def risk_categories(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.RISK_CATEGORY, "domain", "risk_category")


def schedules(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.SCHEDULE_SECONDS, "schedule", "interval_seconds", "bigint")


def model_rates(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.COST_PER_1K, "model", "rate_per_1k", "double")


def industries(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.DOMAIN_INDUSTRY, "domain", "industry")


def warn_days(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.INDUSTRY_WARN_DAYS, "industry", "warn_days", "int")


def event_labels(spark: SparkSession) -> DataFrame:
    return pairs(spark, C.EVENT_LABELS, "event_type", "label")


def routes(spark: SparkSession) -> DataFrame:
    return fixed(
        spark, C.ROUTES, "error_type string, routing_action string, auto_executable boolean, approval string"
    )


def remediation_options(spark: SparkSession) -> DataFrame:
    """One row per failure class with its ordered options."""
    flat = fixed(
        spark,
        C.REMEDIATION_OPTIONS,
        "failure_type string, pos int, action string, description string, estimated_minutes int, "
        "risk_level string, auto_executable boolean",
    )
    option = F.struct("pos", "action", "description", "estimated_minutes", "risk_level", "auto_executable")
    return flat.groupBy("failure_type").agg(
        F.array_sort(F.collect_list(option)).alias("options"),
        F.max(F.col("risk_level") == "High").alias("requires_approval"),
    )


def layer_map(spark: SparkSession) -> DataFrame:
    return fixed(spark, C.LAYER_COLLECTIONS.items(), "layer string, layers array<string>")
