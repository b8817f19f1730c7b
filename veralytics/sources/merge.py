"""Copy-on-write changes of partitioned tables without a table format.

A table is a parquet folder partitioned by columns that follow from a row's key. A change
finds the partitions that it touches, reads those alone, and replaces them; all other
partitions keep their files. Layers and domains are names, not numbers. The new rows are written to the shared folder first, so a
lost executor or a failed job leaves the table as it was until they are complete.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veralytics import config as C
from veralytics.operators.feedback import flag_gold
from veralytics.operators.retrieval import boost_entity, upsert_docs
from veralytics.operators.value import tag_injection
from veralytics.session import stored
from veralytics.sources.sinks import overwrite_partitions

DOC_PARTS = ["layer", "domain", "bucket"]
ROW_PARTS = ["domain", "bucket"]
BUCKETS = 16
# Layers that a rebuild of the index writes anew, and the one that it keeps.
LAYERS, HISTORY = ("gold", "gold_history", "silver", "bronze"), "probe_history"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, parts: list[str]) -> list[tuple]:
    """The partitions that hold these rows; no more than the folders the driver lists anyway."""
    return [tuple(r) for r in rows.select(*parts).distinct().collect()]


def read_parts(spark: SparkSession, path: str, parts: list[str], chosen: list[tuple]) -> DataFrame:
    """The rows of some partitions, by filters on the partition columns, so no other folder is read.

    The last of ``parts`` is a bucket number.
    """
    table = spark.read.parquet(path)
    if not chosen:
        return table.limit(0)
    heads: dict[tuple, list] = {}
    for values in chosen:
        heads.setdefault(values[:-1], []).append(values[-1])
    alike = []
    for head, buckets in heads.items():
        same = [F.col(n).eqNullSafe(F.lit(v).cast(table.schema[n].dataType)) for n, v in zip(parts, head, strict=False)]
        alike.append(reduce(lambda a, b: a & b, same, F.col(parts[-1]).isin(*buckets)))
    while len(alike) > 1:  # a balanced tree, as deep chains of conditions overflow the planner's stack
        alike = [a | b for a, b in zip(alike[::2], alike[1::2], strict=False)] + alike[len(alike) // 2 * 2 :]
    return table.where(alike[0])


def rewrite(spark: SparkSession, path: str, parts: list[str], chosen: list[tuple], change: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the chosen partitions by ``change`` of their rows; returns how many there are.

    ``change`` keeps each row in its partition, and every partition at least one row.
    """
    if chosen:
        after = stored(change(read_parts(spark, path, parts, chosen)))
        overwrite_partitions(after.repartition(*parts), path, parts)
    return len(chosen)


# --- the index of documents ---------------------------------------------------------


def _placed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("bucket", bucket_of(F.col("doc_id")))


def rebuild_index(docs: DataFrame, path: str) -> None:
    """Write the index anew, a folder per layer; the probe history stays as it is.

    ``docs`` (doc_id, layer, domain, ...) as of ``index_build``. Documents that are not in
    ``docs`` any more, and layers that have none left, are gone afterwards.
    """
    rows = stored(_placed(docs.where(F.col("layer") != HISTORY)).repartition(*DOC_PARTS))
    for layer in sorted({r["layer"] for r in rows.select("layer").distinct().collect()} | set(LAYERS)):
        rows.where(F.col("layer") == layer).drop("layer").write.mode("overwrite").partitionBy("domain", "bucket").parquet(f"{path}/layer={layer}")


def upsert_index(incoming: DataFrame, path: str, order: str) -> int:
    """Add documents to the index; one of the same id is replaced, among incoming ones the last in ``order`` wins.

    Only the partitions of incoming documents are read and written. Returns their number.
    """
    spark = incoming.sparkSession
    rows = stored(_placed(incoming))
    chosen = touched(rows, DOC_PARTS)
    return rewrite(spark, path, DOC_PARTS, chosen, lambda old: upsert_docs(old, rows, order).select(*old.columns))


def boost_index(corrections: DataFrame, path: str, as_of: datetime | str, boost: float = C.BOOST) -> int:
    """Raise the weight of corrected entities' gold documents in the partitions that hold them."""
    spark = corrections.sparkSession
    gold = spark.read.parquet(path).where(F.col("layer") == "gold")
    hit = gold.join(corrections.select("domain", "entity").distinct(), ["domain", "entity"], "left_semi")
    return rewrite(spark, path, DOC_PARTS, touched(hit, DOC_PARTS), lambda old: boost_entity(old, corrections, as_of, boost).select(*old.columns))


# --- tables of facts and outcomes ---------------------------------------------------


def write_rows(rows: DataFrame, path: str, key: str) -> None:
    """A table by domain and bucket of ``key``."""
    rows.withColumn("bucket", bucket_of(F.col(key))).write.mode("overwrite").partitionBy(*ROW_PARTS).parquet(path)


def flag_gold_table(corrections: DataFrame, path: str) -> int:
    """``flag_gold`` on the partitions (written by entity) of corrected entities."""
    spark = corrections.sparkSession
    chosen = touched(corrections.withColumn("bucket", bucket_of(F.col("entity"))), ROW_PARTS)
    there = {tuple(r) for r in spark.read.parquet(path).select(*ROW_PARTS).distinct().collect()}
    return rewrite(spark, path, ROW_PARTS, [c for c in chosen if c in there], lambda old: flag_gold(old, corrections).select(*old.columns))


def tag_injection_table(injections: DataFrame, path: str, **rule) -> int:
    """``tag_injection`` on the partitions that hold uncorrected outcomes of injected domains."""
    spark = injections.sparkSession
    open_ = spark.read.parquet(path).where(~F.col("correction_applied"))
    hit = open_.join(injections.select("domain").distinct(), "domain", "left_semi")
    return rewrite(spark, path, ROW_PARTS, touched(hit, ROW_PARTS), lambda old: tag_injection(old, injections, **rule).select(*old.columns))
