"""Bronze, silver and gold layer jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.functions import clock, text
from veralytics.operators.contains_join import contains_join, found_names
from veralytics.operators.ordered_join import ordered_join
from veralytics.session import cut_lineage

TRUTHY = ("true", "1", "yes")


def gold_current(gold: DataFrame) -> DataFrame:
    """Current versions: truthy flag text in any case; a missing flag counts as current."""
    if "is_current" not in gold.columns:
        return gold
    flag = F.lower(F.coalesce(F.col("is_current").cast("string"), F.lit("true")))
    return gold.filter(flag.isin(*TRUTHY))


def gold_contract_check(columns: DataFrame, domains: DataFrame) -> DataFrame:
    """Which required columns each domain's table lacks.

    ``columns`` holds one row per (domain, column_name) that is present.
    """
    required = domains.select(
        "domain", F.explode(F.array(F.lit("is_current"), F.col("key_column"), F.col("value_column"))).alias("column_name")
    ).distinct()
    present = columns.select("domain", "column_name", F.lit(True).alias("_found")).distinct()
    return (
        required.join(present, ["domain", "column_name"], "left")
        .groupBy("domain")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_found").isNull(), F.col("column_name")))).alias("missing"),
            F.count("*").alias("required_columns"),
        )
        .withColumn("valid", F.size("missing") == 0)
    )


def quality_score(required: Sequence[str], columns: Sequence[str]) -> Column:
    """Share of required columns that are present, non-null and non-blank."""
    if not required:
        return F.lit(1.0)
    filled = [F.when(~text.blank(F.col(c).cast("string")), 1).otherwise(0) for c in required if c in columns]
    total = sum(filled, F.lit(0))
    return F.round(total / F.lit(float(len(required))), 4)


def row_fingerprint(keys: Sequence[str]) -> Column:
    """MD5 of the key values joined by | in sorted column-name order; a null reads as None."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in sorted(keys)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _error_flag(columns: Sequence[str]) -> str | None:
    return next((c for c in ("has_nulls", "parse_error") if c in columns), None)


def _is_flag(df: DataFrame, name: str | None, any_case: bool) -> Column:
    if name is None or name not in df.columns:
        return F.lit(False)
    value = F.col(name).cast("string")
    return F.coalesce((F.lower(value) if any_case else value) == "true", F.lit(False))


def bronze_stats(bronze: DataFrame) -> DataFrame:
    """Row counts per domain; here the flag must be exactly ``true``."""
    duplicate = _is_flag(bronze, "is_duplicate", any_case=False)
    broken = _is_flag(bronze, _error_flag(bronze.columns), any_case=False)
    counts = bronze.groupBy("domain").agg(
        F.count("*").alias("total_rows"),
        F.count_if(duplicate).alias("duplicate_rows"),
        F.count_if(broken).alias("null_rows"),
    )
    valid = F.col("total_rows") - F.col("duplicate_rows") - F.col("null_rows")
    return counts.withColumn("valid_rows", valid).withColumn(
        "avg_quality_score", F.round(F.col("valid_rows") / F.greatest(F.col("total_rows"), F.lit(1)), 4)
    )


def silver_refine(
    bronze: DataFrame,
    required: Sequence[str],
    renames: Mapping[str, str] | None = None,
    threshold: float = C.SILVER_QUALITY_THRESHOLD,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Drop flagged rows (flag in any case), score quality, keep good rows, rename columns."""
    duplicate = _is_flag(bronze, "is_duplicate", any_case=True)
    broken = _is_flag(bronze, _error_flag(bronze.columns), any_case=True)
    kept = (
        bronze.filter(~duplicate & ~broken)
        .withColumn("quality_score", quality_score(required, bronze.columns))
        .filter(F.col("quality_score") >= threshold)
    )
    if as_of is not None:
        kept = kept.withColumn("validated_at", clock.moment(as_of))
    return kept.withColumnsRenamed(dict(renames or {}))


def silver_refine_domains(
    bronze: DataFrame,
    required: Mapping[str, Sequence[str]] = C.REQUIRED_COLUMNS,
    renames: Mapping[str, Mapping[str, str]] = C.SILVER_RENAMES,
    threshold: float = C.SILVER_QUALITY_THRESHOLD,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """:func:`silver_refine` of a table of many domains in one pass, each by its own required columns and names.

    Domains without rules keep every row that is not flagged. A renamed column moves its
    values to the new name in the rows of the domain that renames it and stays as it is in
    all others. Rules for columns that the table lacks count as missing values.
    """
    duplicate = _is_flag(bronze, "is_duplicate", any_case=True)
    broken = _is_flag(bronze, _error_flag(bronze.columns), any_case=True)
    domain, quality = F.col("domain"), F.lit(1.0)
    for name, columns in required.items():
        quality = F.when(domain == name, quality_score(columns, bronze.columns)).otherwise(quality)
    kept = bronze.filter(~duplicate & ~broken).withColumn("quality_score", quality).filter(F.col("quality_score") >= threshold)
    moves = [(name, old, new) for name, names in renames.items() for old, new in names.items() if old in bronze.columns]
    moved = {}
    for name, old, new in moves:
        before = moved.get(new, F.col(new) if new in bronze.columns else F.lit(None).cast(bronze.schema[old].dataType))
        moved[new] = F.when(domain == name, F.col(old)).otherwise(before)
    for old in {old for _, old, _ in moves}:
        renaming = [name for name, o, _ in moves if o == old]
        moved[old] = F.when(~domain.isin(*renaming), moved.get(old, F.col(old)))
    if as_of is not None:
        kept = kept.withColumn("validated_at", clock.moment(as_of))
    return kept.withColumns(moved)


def silver_stats(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Promoted rows, removed rows (exact ``true`` flags) and mean quality per domain."""
    removed = bronze.groupBy("domain").agg(
        F.count_if(_is_flag(bronze, "is_duplicate", any_case=False)).alias("duplicate_rows"),
        F.count_if(_is_flag(bronze, _error_flag(bronze.columns), any_case=False)).alias("null_rows"),
    )
    promoted = silver.groupBy("domain").agg(
        F.count("*").alias("total_rows"), F.avg("quality_score").alias("avg_quality_score")
    )
    return removed.join(promoted, "domain", "left").select(
        "domain",
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("total_rows", F.lit(0)).alias("valid_rows"),
        "duplicate_rows",
        "null_rows",
        F.coalesce("avg_quality_score", F.lit(0.0)).alias("avg_quality_score"),
    )


def gold_curate_stats(gold: DataFrame) -> DataFrame:
    """Totals, current rows and rows with any null per domain. Only the text ``true`` is current here."""
    any_null = F.lit(False)
    for name in gold.columns:
        any_null = any_null | F.col(name).isNull()
    current = F.coalesce(F.lower(F.col("is_current").cast("string")) == "true", F.lit(False))
    return gold.groupBy("domain").agg(
        F.count("*").alias("total_rows"),
        F.count_if(current).alias("valid_rows"),
        F.lit(0).cast("bigint").alias("duplicate_rows"),
        F.count_if(any_null).alias("null_rows"),
        F.lit(1.0).alias("avg_quality_score"),
    )


def entity_lookup(gold: DataFrame, requests: DataFrame) -> DataFrame:
    """One current gold row per request: the exact name in any case, else a name that contains it.

    Among several rows the highest version wins, then the smallest entity name.
    """
    found = gold_current(gold).withColumn("_name", F.lower("entity")).withColumnRenamed("entity", "gold_entity")
    rank = F.struct(-F.col("version"), F.col("gold_entity"))
    row = F.struct(*[F.col(c) for c in found.columns if c not in ("domain", "_name")])

    asked = requests.select("domain", F.lower("entity").alias("_needle")).distinct()
    # A name also contains itself, so one pass finds both kinds; per request one row per task is shuffled.
    exact = F.col("_name") == F.col("_needle")
    answers = (
        contains_join(asked, found, "domain", "_needle", "_name")
        .groupBy("domain", "_needle")
        .agg(F.min_by(F.struct(exact.alias("exact"), row.alias("gold")), F.struct(~exact, rank)).alias("_best"))
        .select("domain", "_needle", F.when(F.col("_best.exact"), "exact").otherwise("contains").alias("match_type"), F.col("_best.gold").alias("_gold"))
    )
    joined = requests.withColumn("_needle", F.lower("entity")).join(answers, ["domain", "_needle"], "left")
    taken = set(requests.columns)
    return joined.select(
        *requests.columns,
        F.coalesce("match_type", F.lit("none")).alias("match_type"),
        *[
            F.col(f"_gold.{c}").alias(c if c not in taken else f"gold_{c}")
            for c in found.columns
            if c not in ("domain", "_name")
        ],
    )


def lineage(gold: DataFrame, requests: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Every version whose entity name contains the requested text.

    ``order`` (a column of ``requests``, then columns of ``gold``) puts the rows in that order
    without a sort of them: a text that is in every name gives far more rows than are read.
    """
    needles = requests.select(
        *[F.col(c) for c in requests.columns if c != "entity"],
        F.col("entity").alias("request_entity"),
        F.lower("entity").alias("_needle"),
    )
    extra = [c for c in needles.columns if c not in ("domain", "_needle")]
    names = gold.select("*", F.lower("entity").alias("_name")).drop(*[c for c in extra if c in gold.columns])
    if not order:
        return contains_join(needles, names, "domain", "_needle", "_name").drop("_needle", "_name")
    columns = list(dict.fromkeys(c for c in [*needles.columns, *names.columns] if c not in ("_needle", "_name")))
    found = found_names(needles, names, "domain", "_needle", "_name").drop("_name")
    return ordered_join(needles, found, ["domain", "_needle"], order[0], order[1:], columns)


def medallion_run(
    domains: DataFrame, bronze: DataFrame, silver: DataFrame, gold: DataFrame
) -> DataFrame:
    """One row per domain with the statistics of the three layers; a missing layer gives zeros and an error."""

    def layer(stats: DataFrame, name: str) -> DataFrame:
        measures = ("total_rows", "valid_rows", "duplicate_rows", "null_rows", "avg_quality_score")
        return stats.select("domain", F.struct(*measures).alias(name))

    joined = (
        domains.select("domain")
        .join(layer(bronze_stats(bronze), "bronze"), "domain", "left")
        .join(layer(silver_stats(bronze, silver), "silver"), "domain", "left")
        .join(layer(gold_curate_stats(gold), "gold"), "domain", "left")
    )
    zero = F.struct(
        F.lit(0).cast("bigint").alias("total_rows"),
        F.lit(0).cast("bigint").alias("valid_rows"),
        F.lit(0).cast("bigint").alias("duplicate_rows"),
        F.lit(0).cast("bigint").alias("null_rows"),
        F.lit(0.0).alias("avg_quality_score"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("bronze").isNull(), F.lit("Bronze ingestion failed")),
            F.when(F.col("silver").isNull(), F.lit("Silver refinery failed")),
            F.when(F.col("gold").isNull(), F.lit("Gold curation failed")),
        )
    )
    return joined.select(
        "domain",
        *[F.coalesce(F.col(x), zero).alias(x) for x in ("bronze", "silver", "gold")],
        errors.alias("errors"),
    ).select(
        "*",
        F.col("silver.total_rows").alias("rows_promoted_to_silver"),
        F.col("gold.valid_rows").alias("rows_promoted_to_gold"),
        (F.size("errors") == 0).alias("success"),
    )
