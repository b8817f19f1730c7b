"""Exact median per key without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKETS = 4096


def exact_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median) over the non-null values, interpolating between the two middle ones.

    Equal values are counted first. A histogram of 4,096 equal steps then tells which step
    holds the middle ranks, and only the distinct values of that step are ordered.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    span = counted.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    step = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    stepped = counted.join(span, by).withColumn("_step", step)
    # Ranks (from 1) of the lower and upper middle value.
    low = F.floor((F.col("_all") + 1) / 2).cast("bigint")
    high = F.floor(F.col("_all") / 2).cast("bigint") + 1

    def holding(rows: DataFrame, group: list[str], order: str, base: str | None) -> DataFrame:
        before = F.coalesce(
            F.sum("_n").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        )
        if base is not None:
            before = before + F.col(base)
        placed = rows.withColumn("_before", before)
        return placed.filter((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low))

    histogram = stepped.groupBy(by, "_step", "_all").agg(F.sum("_n").alias("_n"))
    middle_steps = holding(histogram, [by], "_step", None).select(by, "_step", F.col("_before").alias("_base"))
    middle = holding(stepped.join(middle_steps, [by, "_step"]), [by, "_step"], "_v", "_base")
    covers_low = (F.col("_before") < low) & (F.col("_before") + F.col("_n") >= low)
    covers_high = (F.col("_before") < high) & (F.col("_before") + F.col("_n") >= high)
    return middle.groupBy(by).agg(
        ((F.max(F.when(covers_low, F.col("_v"))) + F.max(F.when(covers_high, F.col("_v")))) / 2).alias("median")
    )
