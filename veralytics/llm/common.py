"""Reading, cutting of lineage and batching shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of text that one step inside a task holds as words at a time.
CHUNK_CHARS = 2_000_000
# Bytes of text that one step takes of an Arrow batch.
SLICE_BYTES = 1_000_000
# CRC-32 of the ASCII text ``k`` in SQL without such a function, bit by bit.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only for a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"/tmp/llm-{uuid.uuid4().hex}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in df.columns])


def chunks(texts: Sequence, chars: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of ``texts`` with about ``chars`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > chars:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def sliced(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about ``size`` bytes of text, each with its texts; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        part = batch.slice(start, end - start)
        yield part, part.column("text").to_pylist()
        start = end
