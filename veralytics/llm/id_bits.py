"""A bitmap of fixed size over a table of ids, to pass by most other rows without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.shingles import mixed

# 2**26 bits are 8 MB in every task, whatever the number of ids; more ids only mean that more rows are looked up exactly.
BITS = 26


def _place(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)


def bitmap(ids: DataFrame) -> np.ndarray:
    """The bits of the ids in column ``id``."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = _place(batch["id"].to_numpy())
            bit = np.left_shift(np.int64(1), (place & np.uint64(63)).astype(np.int64))
            yield pd.DataFrame({"word": (place >> np.uint64(6)).astype(np.int64), "bits": bit})

    rows = ids.where("id IS NOT NULL").select("id").mapInPandas(words, "word long, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2**20 rows at most
    out = np.zeros(2 ** (BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def hits(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Whether each id may be among the bitmap's; never false for one that is. Nulls are not."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    place = _place(ids.fill_null(0).to_numpy(zero_copy_only=False))
    bit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1
    return (bit == 1) & ~null


def parted(docs: DataFrame, bits: np.ndarray, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may be among the ids, and those that are not; only the key goes to Python."""

    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(hits(bits, ids))

    may = F.arrow_udf(maybe, "boolean")(docs[key].cast("long"))
    return docs.where(may), docs.where(~may)
