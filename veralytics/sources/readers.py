"""Readers. Every schema is given, nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veralytics.functions import clock
from veralytics.sources import schemas

_GOLD_PLAIN = (
    "model_belief", "effective_date", "version", "is_current", "expiry_date", "industry", "recommended_action", "staleness_reason",
)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def gold_read(spark: SparkSession, path: str, domain: str, key_column: str, value_column: str) -> DataFrame:
    """One domain's gold CSV as rows of the tall gold table; a missing file gives no rows.

    Cells stay text. Columns of the file that have no column of their own go to ``attrs``.
    """
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if _missing(error):
            return _empty(spark, schemas.GOLD)
        raise

    def cell(name: str):
        return (F.col(f"`{name}`") if name in raw.columns else F.lit(None)).cast("string")

    rest = [c for c in raw.columns if c not in (*_GOLD_PLAIN, key_column, value_column)]
    attrs = F.create_map(*[x for c in rest for x in (F.lit(c), cell(c))]) if rest else F.create_map().cast("map<string,string>")
    return raw.select(
        F.lit(domain).alias("domain"),
        cell(key_column).alias("entity"),
        cell(value_column).alias("value"),
        attrs.cast("map<string,string>").alias("attrs"),
        *[cell(c).alias(c) for c in _GOLD_PLAIN],
    )


def gold_read_all(spark: SparkSession, folder: str, domains: Mapping[str, tuple[str, str]]) -> DataFrame:
    """All configured domains of a folder; ``domains`` maps a name to its key and value column."""
    out = _empty(spark, schemas.GOLD)
    for name, (key, value) in domains.items():
        out = out.unionByName(gold_read(spark, f"{folder.rstrip('/')}/{name}.csv", name, key, value))
    return out


def table_columns(frames: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(domain, column_name) of the given tables, the input of the contract check."""
    rows = [(domain, name) for domain, df in frames.items() for name in df.columns]
    return spark.createDataFrame(rows, "domain string, column_name string")


def _events(raw: DataFrame) -> DataFrame:
    required = [F.col(c).isNotNull() for c in ("source_module", "event_type", "domain", "payload")]
    good = raw.filter(F.col("_corrupt_record").isNull())
    for test in required:
        good = good.filter(test)
    return good.select(
        "event_id",
        clock.utc_text(F.col("timestamp")).alias("event_ts"),
        "source_module",
        "event_type",
        "domain",
        "entity",
        "payload",
        F.coalesce("severity", F.lit("INFO")).alias("severity"),
        F.coalesce("requires_approval", F.lit(False)).alias("requires_approval"),
    ).filter(F.col("event_ts").isNotNull())


def event_log_read(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines event log; blank, broken and incomplete lines are dropped."""
    try:
        reader = spark.read.schema(schemas.EVENT_JSON).option("mode", "PERMISSIVE")
        return _events(reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    except AnalysisException as error:
        if _missing(error):
            return _empty(spark, schemas.EVENT)
        raise


def event_log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same log as a stream over the files of a folder."""
    reader = spark.readStream.schema(schemas.EVENT_JSON).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _events(reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def run_results_ingest(spark: SparkSession, path: str, models: DataFrame, per_line: bool = False) -> DataFrame:
    """Run artifacts as run rows, for the models whose name ends the result's id.

    An artifact is one JSON document per file, or one per line with ``per_line``.
    ``models`` (dbt_model) is the pipeline map. The ids are matched by their ends of the
    lengths that occur among the names, which makes an equi-join of it.
    """
    raw = spark.read.schema(schemas.RUN_RESULTS).option("multiLine", not per_line).json(path)
    results = raw.select(F.col("metadata.generated_at").alias("_at"), F.explode("results").alias("r"))
    names = models.select("dbt_model").distinct()
    lengths = names.agg(F.collect_set(F.length("dbt_model"))).scalar()
    uid = F.col("r.unique_id")
    cut = results.withColumn("_n", F.explode(lengths)).filter(F.length(uid) >= F.col("_n"))
    matched = cut.withColumn("dbt_model", F.right(uid, F.col("_n"))).join(names, "dbt_model")
    return matched.select(
        F.right(uid, F.lit(8)).alias("run_id"),
        "dbt_model",
        F.replace("dbt_model", F.lit("fct_"), F.lit("")).alias("domain"),
        clock.utc_text(F.col("_at")).alias("run_timestamp"),
        F.coalesce("r.status", F.lit("unknown")).alias("status"),
        F.coalesce("r.execution_time", F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("r.adapter_response.rows_affected", F.lit(0)).alias("rows_affected"),
        F.coalesce("r.message", F.lit("")).alias("error_message"),
        F.lit("dbt-live").alias("schema_version"),
        F.concat("dbt_model", F.lit("_raw")).alias("source_table"),
    )


def decisions_read(spark: SparkSession, path: str) -> DataFrame:
    """Decision log CSV with UTC times and money in whole cents."""
    raw = spark.read.schema(schemas.DECISION).option("header", True).csv(path)
    return raw.select(
        clock.utc_text(F.col("timestamp")).alias("decided_at"),
        "domain",
        "decision_outcome",
        F.round(F.col("risk_amount_usd") * 100).cast("bigint").alias("risk_cents"),
    )


def profiles_read(spark: SparkSession, path: str) -> DataFrame:
    """Company profiles from JSON files, one row per company and domain."""
    raw = spark.read.schema(schemas.PROFILE).option("multiLine", True).json(path)
    return profile_rows(raw.filter(F.col("company.id").isNotNull()))


def profiles_from_yaml(spark: SparkSession, documents: list[str]) -> DataFrame:
    """Company profiles from YAML texts (configuration files), where a YAML parser is installed."""
    import json

    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML profiles needs a YAML parser; use JSON profiles instead") from error
    parsed = [(json.dumps(yaml.safe_load(d)),) for d in documents]
    schema = T.StructType.fromDDL(schemas.PROFILE)
    rows = spark.createDataFrame(parsed, "doc string").select(F.from_json("doc", schema).alias("_p")).select("_p.*")
    return profile_rows(rows.filter(F.col("company.id").isNotNull()))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Nested profiles as flat rows."""
    listed = profiles.select(
        F.col("company.id").alias("company_id"), F.col("company.display_name").alias("company_name"), F.explode("domains").alias("domain_key", "d")
    )
    cost_key = F.element_at(F.filter(F.map_keys("d.business_impact"), lambda k: F.contains(F.lower(k), F.lit("cost"))), 1)
    return listed.select(
        "company_id",
        "company_name",
        "domain_key",
        F.col("d.display_name").alias("domain_name"),
        F.col("d.probe_schedule").alias("probe_schedule"),
        F.col("d.probe_questions").alias("questions"),
        F.col("d.staleness_thresholds.fresh").alias("fresh"),
        F.col("d.staleness_thresholds.stale").alias("stale"),
        F.try_element_at("d.business_impact", F.lit("decisions_per_month")).cast("int").alias("decisions_per_month"),
        F.try_element_at("d.business_impact", cost_key).alias("cost_usd"),
        F.col("d.medallion.gold.key_column").alias("key_column"),
        F.col("d.medallion.gold.value_column").alias("value_column"),
    )
