"""Joins of a large side with few, busy keys against a small side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 32
_PART = "_spread_part"


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``big`` joined with ``small``, with every key of ``big`` spread over ``parts`` tasks.

    A handful of keys would mean a handful of busy tasks. ``spread_by`` names columns of
    ``big`` that differ within a key; their hash picks the part, so the same row goes to the
    same part when a lost task is run again. ``small`` has few rows per key and is copied to
    each part; where Spark finds it small enough to be sent to all tasks, neither side moves.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing, as in any join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the small side cannot be kept whole by a {how} join")
    part = F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
    copies = small.withColumn(_PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return big.withColumn(_PART, part).join(copies, [*on, _PART], how).drop(_PART)
