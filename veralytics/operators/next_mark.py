"""For each point in time the next mark at or after it, per key.

A window over a whole key would sort a hot key in one task. Instead the search runs
on three levels: inside the point's own second, over the later seconds of its hour
and over later hours. Times are de-duplicated first, so a group never holds more
than the million distinct microseconds of a second, 3,600 seconds, or one row per
hour of the data's time span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics.functions import clock

SECOND = 1_000_000
HOUR = 3_600 * SECOND


def next_mark(points: DataFrame, marks: DataFrame, by: str, at: str, payload: list[str]) -> DataFrame:
    """Distinct (by, at) of ``points`` with ``mark``: struct(at, *payload) of the next mark, or null.

    Among marks at the same time the smallest payload wins.
    """

    def slots(df: DataFrame) -> DataFrame:
        micros = clock.epoch_micros(F.col(at))
        return df.withColumn("_second", clock.floor_div(micros, SECOND)).withColumn("_hour", clock.floor_div(micros, HOUR))

    asked = slots(points.select(by, at).distinct())
    offered = slots(
        marks.select(by, at, F.struct(at, *payload).alias("mark")).groupBy(by, at).agg(F.min("mark").alias("mark"))
    )
    first_of_second = offered.groupBy(by, "_hour", "_second").agg(F.min("mark").alias("_first"))
    first_of_hour = first_of_second.groupBy(by, "_hour").agg(F.min("_first").alias("_first"))

    within = _following(asked, offered, [by, "_second"], at, "mark", inclusive=True).select(by, at, "_second", "_hour", "found")
    seconds = _following(
        asked.select(by, "_hour", "_second").distinct(), first_of_second, [by, "_hour"], "_second", "_first", inclusive=False
    ).select(by, "_second", F.col("found").alias("_later_second"))
    hours = _following(
        asked.select(by, "_hour").distinct(), first_of_hour, [by], "_hour", "_first", inclusive=False
    ).select(by, "_hour", F.col("found").alias("_later_hour"))
    return (
        within.join(seconds, [by, "_second"])
        .join(hours, [by, "_hour"])
        .select(by, at, F.coalesce("found", "_later_second", "_later_hour").alias("mark"))
    )


def _following(asked: DataFrame, offered: DataFrame, group: list[str], order: str, mark: str, inclusive: bool) -> DataFrame:
    """``found``: the smallest mark at a later (or equal) position of the group, for the asked rows."""
    both = asked.withColumn("_asked", F.lit(True)).withColumn("_mark", F.lit(None).cast(dict(offered.dtypes)[mark])).unionByName(
        offered.withColumnRenamed(mark, "_mark").withColumn("_asked", F.lit(False)).select(*asked.columns, "_asked", "_mark")
    )
    # Descending order turns "all later rows" into a running minimum.
    window = W.partitionBy(*group).orderBy(F.desc(order))
    window = window.rangeBetween(W.unboundedPreceding, W.currentRow) if inclusive else window
    if inclusive:
        found: Column = F.min("_mark").over(window)
        return both.withColumn("found", found).filter("_asked")
    merged = both.groupBy(*dict.fromkeys([*group, order])).agg(F.max("_asked").alias("_asked"), F.min("_mark").alias("_mark"))
    found = F.min("_mark").over(window.rowsBetween(W.unboundedPreceding, -1))
    return merged.withColumn("found", found).filter("_asked")
