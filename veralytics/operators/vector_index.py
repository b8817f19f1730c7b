"""A stored cluster index of vectors, searched exactly or fast.

The centers of the clusters are fitted on a bounded sample; every row is indexed, under
the center nearest to it and with its angle to it. A cluster of many rows is dealt to
parts of bounded size. For a query, the angles of a cluster's rows lie between its least
and its largest one, so by the triangle inequality of angles no row of the cluster is
nearer than the difference to the query's own angle.

Exact search scores the clusters with the best bounds until they hold k rows, which gives
each query a score that its k-th best row reaches at least, and then only those other
clusters whose bound reaches it. Fast search scores the nearest clusters alone. Queries
travel to the clusters, rows are never copied: a task holds one part and passes its
queries by as a stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics.operators import contains_join, vector_join
from veralytics.operators.contains_join import runs
from veralytics.operators.vector_join import best_of, cosine, unit, whole_vector
from veralytics.session import stored

# The functions of these modules travel to the tasks by value.
for _module in (sys.modules[__name__], contains_join, vector_join):
    cloudpickle.register_pickle_by_value(_module)

# Rows that the centers are fitted on at most, rounds of fitting, clusters at most and rows that ask for one more cluster.
SAMPLE, ROUNDS, CLUSTERS, CLUSTER_ROWS = 8_192, 8, 256, 2_048
# Rows of a part.
PART_ROWS = 16_384
# Queries that a fast search is calibrated on, and the share of the exact results it is to find.
CALIBRATION, RECALL = 256, 0.95
# Above the rounding of angles, scores and their ranking.
SLACK = 1e-6
ROWS = "by string, dim int, cluster int, doc_id bigint, embedding array<double>, angle double"


def fit(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Centers of unit length by spherical k-means, starting from evenly spaced rows."""
    centers = vectors[np.linspace(0, len(vectors) - 1, min(clusters, len(vectors))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (vectors @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


def _angles(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centers.T, -1.0, 1.0))


def _typed(df: DataFrame, key: str, by: str) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    kept = df.where(whole_vector("embedding") & F.col(by).isNotNull() & F.col(key).isNotNull())
    return kept.select(F.col(by).cast("string").alias("by"), F.size("embedding").alias("dim"), F.col(key).cast("bigint").alias(key), vector.alias("embedding"))


@dataclass
class VectorIndex:
    """Rows (by, dim, cluster, part, doc_id, embedding, angle) and the centers by vector length."""

    rows: DataFrame
    centers: dict[int, np.ndarray]

    def write(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
        listed = [(dim, n, c.tolist()) for dim, centers in self.centers.items() for n, c in enumerate(centers)]
        spark = self.rows.sparkSession
        spark.createDataFrame(listed, "dim int, n int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        listed = spark.read.parquet(f"{path}/centers").orderBy("dim", "n").collect()  # CLUSTERS rows per vector length
        centers: dict[int, list] = {}
        for r in listed:
            centers.setdefault(r["dim"], []).append(r["center"])
        return VectorIndex(spark.read.parquet(f"{path}/rows"), {d: np.array(c) for d, c in centers.items()})


def build(docs: DataFrame, by: str, clusters: int | None = None) -> VectorIndex:
    """Index ``docs`` (doc_id BIGINT, by STRING, embedding); only rows with the same ``by`` and vector length meet.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor
    do rows without a key. Centers are fitted on the ``SAMPLE`` rows with the smallest
    hashes; a length that the sample lacks has one cluster, whose bound allows everything.
    """
    typed = _typed(docs, "doc_id", by)
    clusters = clusters or max(1, min(CLUSTERS, -(-typed.count() // CLUSTER_ROWS)))
    sample = typed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("dim", "embedding").toPandas()
    centers = {int(dim): fit(unit(part["embedding"]), clusters) for dim, part in sample.groupby("dim")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                angle = np.full((len(part), 1), np.pi / 2) if dim not in centers else _angles(unit(part["embedding"]), centers[dim])
                own = angle.argmin(axis=1)
                yield part.assign(cluster=own.astype(np.int32), angle=angle[np.arange(len(part)), own])[[c.split()[0] for c in ROWS.split(", ")]]

    placed = stored(typed.mapInPandas(place, ROWS))
    sizes = placed.groupBy("by", "dim", "cluster").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("doc_id"), "_parts").cast("int").alias("part")
    return VectorIndex(stored(placed.join(sizes, ["by", "dim", "cluster"]).select("*", part).drop("_parts")), centers)


class Search:
    """Queries (query_id, by, embedding) against an index."""

    def __init__(self, queries: DataFrame, index: VectorIndex, k: int, by: str) -> None:
        self.rows, self.k, self.by, centers = index.rows, k, by, index.centers
        self.queries = stored(_typed(queries, "query_id", by))
        self.parts = stored(self.rows.groupBy("by", "dim", "cluster", "part").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    angle = np.full((len(part), 1), np.pi / 2) if dim not in centers else _angles(unit(part["embedding"]), centers[dim])
                    for c in range(angle.shape[1]):
                        yield pd.DataFrame({"query_id": part["query_id"], "by": part["by"], "dim": dim, "cluster": c, "own": angle[:, c], "known": dim in centers})

        angles = self.queries.mapInPandas(near, "query_id bigint, by string, dim int, cluster int, own double, known boolean")
        clusters = self.parts.groupBy("by", "dim", "cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        gap = F.greatest(F.lit(0.0), F.col("own") - F.col("high"), F.col("low") - F.col("own"))
        bound = F.when(F.col("known"), F.cos(F.least(gap, F.lit(np.pi)))).otherwise(1.0)
        self.probes = stored(angles.join(clusters, ["by", "dim", "cluster"]).select("query_id", "by", "dim", "cluster", "own", "n", bound.alias("bound")))

    def scored(self, probes: DataFrame) -> DataFrame:
        """The best rows of each chosen part that reach the query's ``least`` score: (query_id, by, doc_id, score)."""
        key, k = ("by", "dim", "cluster", "part"), self.k
        null = lambda kind, name: F.lit(None).cast(kind).alias(name)
        stays = self.rows.select(*key, F.lit(0).alias("side"), F.col("doc_id").alias("id"), "embedding", null("double", "least"))
        asked = probes.join(self.queries, ["query_id", "by", "dim"]).join(self.parts.select(*key), ["by", "dim", "cluster"])
        asked = asked.select(*key, F.lit(1).alias("side"), F.col("query_id").alias("id"), "embedding", "least")
        n = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = stays.union(asked).repartition(n, *key).sortWithinPartitions(*key, "side")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ready = None, [], None
            for batch in batches:
                for start, end in runs(batch, (*key, "side")):
                    own = tuple(batch.column(c)[start].as_py() for c in key)
                    if own != at:
                        at, held, ready = own, [], None
                    part = batch.slice(start, end - start)
                    if part.column("side")[0].as_py() == 0:
                        held.append(part.select(["id", "embedding"]))
                        continue
                    if not held:
                        continue
                    if ready is None:
                        rows = pa.Table.from_batches(held).to_pandas()
                        ready = rows["id"].to_numpy(), unit(rows["embedding"])
                    asks = part.select(["id", "embedding", "least"]).to_pandas()
                    found = best_of(asks["id"].to_numpy(), ready[0], cosine(unit(asks["embedding"]), ready[1]), k)
                    least = asks["least"].fillna(-1.0).to_numpy()
                    found = found[found["score"] >= pd.Series(least, index=asks["id"]).groupby(level=0).min().reindex(found["query_id"]).to_numpy()]
                    if len(found):
                        yield pa.RecordBatch.from_pandas(found.assign(by=own[0])[["query_id", "by", "doc_id", "score"]], preserve_index=False)

        return both.mapInArrow(meet, "query_id bigint, by string, doc_id bigint, score double")

    def _ranked(self, found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id", "by").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        return found.withColumnRenamed("by", self.by)

    def open_probes(self) -> tuple[DataFrame, DataFrame]:
        """The rows of the best clusters, and the other clusters that may hold one of a query's best rows."""
        order = W.partitionBy("query_id", "by", "dim").orderBy(F.desc("bound"), "own", "cluster")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = stored(self.probes.withColumn("before", before))
        first = stored(self.scored(ranked.where(F.col("before") < self.k).withColumn("least", F.lit(None).cast("double"))))
        best = W.partitionBy("query_id", "by").orderBy(F.desc("score"))
        kth = first.withColumn("_no", F.row_number().over(best)).where(F.col("_no") == self.k)
        kth = kth.select("query_id", "by", (F.col("score") - SLACK).alias("least"))
        left = ranked.where(F.col("before") >= self.k).join(kth, ["query_id", "by"], "left")
        return first, stored(left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))))

    def exact(self) -> DataFrame:
        first, left = self.open_probes()
        return self._ranked(first.union(self.scored(left)))

    def fast(self, probes: int) -> DataFrame:
        order = W.partitionBy("query_id", "by", "dim").orderBy("own", "cluster")
        chosen = self.probes.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= probes)
        return self._ranked(self.scored(chosen.withColumn("least", F.lit(None).cast("double"))))


def probes_for(index: VectorIndex, k: int, recall: float = RECALL) -> int:
    """The fewest nearest clusters that hold this share of the exact results.

    Measured on the ``CALIBRATION`` indexed rows with the smallest hashes, taken as queries;
    each looks for its k nearest rows but itself. How many that are depends on the data:
    few where vectors form clusters, most where they point everywhere alike.
    """
    sample = index.rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION)
    asked = Search(sample.select(F.col("doc_id").alias("query_id"), "by", "embedding"), index, k + 1, "by")
    order = W.partitionBy("query_id", "by", "dim").orderBy("own", "cluster")
    places = asked.probes.withColumn("place", F.row_number().over(order)).select("query_id", "by", "cluster", "place")
    found = asked.exact().where("query_id <> doc_id").select("query_id", "by", "doc_id")
    where = found.join(index.rows.select("by", "doc_id", "cluster"), ["by", "doc_id"]).join(places, ["query_id", "by", "cluster"])
    counts = sorted(where.groupBy("place").count().collect())  # one row per cluster at most
    held, total = 0, sum(r["count"] for r in counts)
    for r in counts:
        held += r["count"]
        if held >= recall * total:
            return int(r["place"])
    return 1


def search(queries: DataFrame, index: VectorIndex, k: int, by: str, probes: int | None = None) -> DataFrame:
    """Top k rows per (query_id, by) by cosine clipped to 0..1: (query_id, by, doc_id, score, rank).

    Exact without ``probes``, else among the rows of that many nearest clusters. Ties go
    to the smaller doc_id; rows of one (query_id, by) with vectors of several lengths are
    one query.
    """
    asked = Search(queries, index, k, by)
    return asked.exact() if probes is None else asked.fast(probes)
