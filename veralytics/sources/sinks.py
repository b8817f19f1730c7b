"""Writers. Tables are plain parquet or JSON folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veralytics.session import shared_folder


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in order; missing ones become null, others are dropped."""
    fields = T.StructType.fromDDL(schema).fields
    present = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def append_table(df: DataFrame, path: str, schema: str, partition_by: list[str] | None = None) -> None:
    """Append rows of a fixed column layout."""
    writer = conform(df, schema).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def event_log_append(events: DataFrame, path: str) -> None:
    """Append events, one folder per day, with bloom filters on the entity."""
    dated = events.withColumn("event_date", F.col("event_ts").cast("date"))
    dated.write.mode("append").option("parquet.bloom.filter.enabled#entity", "true").partitionBy("event_date").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for (upserts without a table format)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def finetune_jsonl_sink(pairs: DataFrame, path: str) -> None:
    """Append one JSON object per pair."""
    pairs.select("instruction", "response").write.mode("append").json(path)


def gap_report_sink(ranked: DataFrame, path: str) -> None:
    """Write ranked gaps as JSON; the files follow the ranking in name order."""
    columns = ["domain", "entity", "case_type", "query", "suggested_probe", "best_score"]
    ranked.select(*[c for c in columns if c in ranked.columns]).write.mode("overwrite").json(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
