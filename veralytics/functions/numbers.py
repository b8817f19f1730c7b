"""Numbers held inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:\.[0-9]+)?)\s*([BbMmKk%])?"


def extract_number(text: Column) -> Column:
    """First number in a text, scaled by its suffix; null when there is none.

    Commas are removed first and the sign is ignored. The suffix letter counts
    even as the start of a word: ``5 million`` is five million.
    """
    bare = F.regexp_replace(text, ",", "")
    base = F.regexp_extract(bare, NUMBER, 1).try_cast("double")
    suffix = F.upper(F.regexp_extract(bare, NUMBER, 2))
    return (
        F.when(suffix == "B", base * 1e9)
        .when(suffix == "M", base * 1e6)
        .when(suffix == "K", base * 1e3)
        .when(suffix == "%", base / 100.0)
        .otherwise(base)
    )


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """Rounded part/whole; 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))
