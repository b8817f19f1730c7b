"""Domain dimension from the base configuration and company profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def company_domains(profiles: DataFrame) -> DataFrame:
    """Profile domains under ``company__domain`` keys; the schedule is manual when not given."""
    key = F.concat_ws("__", "company_id", "domain_key")
    return profiles.withColumn("domain", key).withColumn("probe_schedule", F.coalesce("probe_schedule", F.lit("manual")))


def domain_dim(base: DataFrame, profiles: DataFrame) -> DataFrame:
    """Base domains and company domains in one table; a company domain replaces a base one of its name."""
    own = company_domains(profiles).withColumn("display_name", F.col("domain_name"))
    shared = base.withColumn("company_id", F.lit(None).cast("string")).withColumn("probe_schedule", F.lit("manual"))
    kept = shared.join(own.select("domain"), "domain", "left_anti")
    columns = [c for c in shared.columns if c in own.columns or c in ("company_id", "probe_schedule")]
    return kept.select(*columns).unionByName(own.select(*columns))


def domain_label(profiles: DataFrame) -> DataFrame:
    """Display name ``Company — Domain`` per key; a missing name falls back to the key."""
    return company_domains(profiles).select(
        F.col("domain").alias("domain_key"),
        F.concat(F.coalesce("company_name", "company_id"), F.lit(" — "), F.coalesce("domain_name", F.col("domain_key"))).alias("label"),
        F.coalesce("company_name", "company_id").alias("company_name"),
        F.coalesce("domain_name", F.col("domain")).alias("domain_name"),
    )
