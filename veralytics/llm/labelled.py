"""The bounded training sample that the learned operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that a model is fitted on at most; everything else covers all rows.
SAMPLE_ROWS = 20_000
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the documents whose labels no model sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows of ``stats`` with column ``y``: those with the smallest hashes of doc_id.

    Labels of held-out documents, null labels and labels other than 0 and 1 are left out.
    """
    given = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    return stats.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
