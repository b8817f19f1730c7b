"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[a-z0-9]+"


def word_set(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def space_set(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)))


def tokenize(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def set_jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two token sets; 0 when either is empty."""
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)),
    ).otherwise(F.lit(0.0))


def token_jaccard(left: Column, right: Column) -> Column:
    """Word-token Jaccard of two texts."""
    return set_jaccard(word_set(left), word_set(right))


def slug(text: Column, chars: int) -> Column:
    """Lower case, everything outside a-z, 0-9 and _ becomes _."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9_]", "_"), 1, chars)


# All white space: blanks, tabs, line ends and the wide and fixed blanks of Unicode.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE))


def blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | (stripped(text) == "")


def values_match(left: Column, right: Column) -> Column:
    """Equal after lower case, trim and removal of trailing ``.,;:``."""

    def norm(value: Column) -> Column:
        return F.regexp_replace(stripped(F.lower(value)), r"[.,;:]+$", "")

    return norm(left) == norm(right)


def thousands(value: Column) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(value, 0)


def strip_units(value: Column) -> Column:
    """Drop a leading currency sign and everything from the first / or space on."""
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(value), r"^[\$£€¥₹\s]+", ""), r"(?s)[/\s].*$", ""))
    return F.when(bare != "", bare).otherwise(stripped(value))
