"""Exact nearest rows by cosine similarity, without forming a row per pair.

Each task multiplies a block of stored vectors with a block of asked vectors and keeps
only the best, so what is shuffled is k rows per query and task. A side of checked,
bounded size is sent to every task and the other side is not moved at all. Beyond that
bound both sides are cut into blocks that meet pairwise, so no task ever holds an
unbounded side, however large one collection is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The functions of this module travel to the tasks by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a side that is sent whole to every task, and components of their vectors: at most this many.
SENT_ROWS, SENT_COMPONENTS = 2_048, 8_000_000
DOC_BLOCK = 65_536
# Scores are ranked at twelve digits, so the order does not hang on how blocks were cut.
RANK_DIGITS = 12


def is_bounded(df: DataFrame, rows: int = SENT_ROWS) -> bool:
    """Does the table have at most so many rows, and its vectors so many components? Reads no further than that."""
    size = F.sum(F.size("embedding")) if "embedding" in df.columns else F.lit(0)
    n, components = df.limit(rows + 1).agg(F.count("*"), size).first()
    return n <= rows and (components or 0) <= SENT_COMPONENTS


def whole_vector(name: str) -> Column:
    """Not null, not empty, all components given and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(name) > 0) & F.forall(F.col(name).cast("array<double>"), fine), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def best_of(query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best columns per row of a score matrix; ties go to the smaller document id."""
    n = scores.shape[1]
    rows, columns = [], []
    floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    for i in range(len(scores)):
        candidates = np.flatnonzero(scores[i] >= floor[i])
        order = np.lexsort((doc_ids[candidates], -scores[i][candidates]))[:k]
        columns.append(candidates[order])
        rows.append(np.full(len(order), i))
    r, c = np.concatenate(rows), np.concatenate(columns)
    return pd.DataFrame({"query_id": query_ids[r], "doc_id": doc_ids[c], "score": scores[r, c]})


def cosine(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.round(np.clip(queries @ docs.T, 0.0, 1.0), RANK_DIGITS)


def merge_best(kept: pd.DataFrame | None, found: pd.DataFrame, k: int) -> pd.DataFrame:
    if kept is None:
        return found
    both = pd.concat([kept, found]).sort_values(["score", "doc_id"], ascending=[False, True])
    return both.groupby("query_id").head(k)


def _typed(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rows that take part: a key, a ``by`` and a whole vector; ``by`` is marked with the vector's length."""
    marked = F.concat(F.size("embedding").cast("string"), F.lit(":"), F.col(by).cast("string"))
    kept = df.where(whole_vector("embedding") & F.col(key).isNotNull() & F.col(by).isNotNull())
    return kept.select(F.col(key).cast("bigint").alias(key), marked.alias(by), "embedding")


def _unmarked(found: DataFrame, by: str) -> DataFrame:
    return found.withColumn(by, F.regexp_replace(by, r"^[0-9]+:", ""))


def vector_topk(queries: DataFrame, docs: DataFrame, k: int, by: str) -> DataFrame:
    """Top k documents per (query_id, by) by cosine similarity clipped to 0..1.

    ``queries`` (query_id BIGINT, by STRING, embedding), ``docs`` (doc_id BIGINT, by STRING,
    embedding); only rows with the same ``by`` and vectors of one length meet. Vectors that are
    null, empty or hold a null or non-finite component take no part. Returns (query_id, by,
    doc_id, score, rank).
    """
    asked, stored = _typed(queries, "query_id", by), _typed(docs, "doc_id", by)
    local = _sent_queries(asked, stored, k, by) if is_bounded(asked) else _blocks(asked, stored, k, by)
    return _unmarked(keep_best(local, k, [by]), by)


def keep_best(local: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k best over all tasks; Spark applies the rank limit per task before the exchange too."""
    best = W.partitionBy("query_id", *by).orderBy(F.desc("score"), "doc_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """The best anchor of the same ``by`` for each row: (query_id, by, doc_id, score).

    ``rows`` (query_id, by, embedding) may be any number; ``anchors`` (doc_id, by, embedding)
    are few as a rule and then sent to the tasks, so that rows stay where they are.
    """
    asked, stored = _typed(rows, "query_id", by), _typed(anchors, "doc_id", by)
    if not is_bounded(stored):
        return _unmarked(keep_best(_blocks(asked, stored, 1, by), 1, [by]).drop("rank"), by)
    sent = stored.toPandas().sort_values("doc_id")  # at most SENT_ROWS rows
    groups = {key: (part["doc_id"].to_numpy(), unit(part["embedding"])) for key, part in sent.groupby(by)}
    known = rows.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(by):
                if key not in known.value:
                    continue
                ids, matrix = known.value[key]
                scores = cosine(unit(part["embedding"]), matrix)
                first = scores.argmax(axis=1)
                yield pd.DataFrame(
                    {"query_id": part["query_id"], "doc_id": ids[first], "score": scores[np.arange(len(first)), first], by: key}
                )

    return _unmarked(asked.mapInPandas(scan, f"query_id bigint, doc_id bigint, score double, {by} string"), by)


def _sent_queries(asked: DataFrame, stored: DataFrame, k: int, by: str) -> DataFrame:
    sent = asked.toPandas()  # at most SENT_ROWS rows, checked by the caller
    groups = {key: (rows["query_id"].to_numpy(), unit(rows["embedding"])) for key, rows in sent.groupby(by)}
    known = asked.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for key, rows in batch.groupby(by):
                if key not in known.value:
                    continue
                ids, matrix = known.value[key]
                found = best_of(ids, rows["doc_id"].to_numpy(), cosine(matrix, unit(rows["embedding"])), k)
                kept[key] = merge_best(kept.get(key), found, k)
        for key, found in kept.items():
            yield found.assign(**{by: key})

    return stored.mapInPandas(scan, f"query_id bigint, doc_id bigint, score double, {by} string")


def _blocks(asked: DataFrame, stored: DataFrame, k: int, by: str) -> DataFrame:
    query_blocks = max(1, -(-asked.count() // SENT_ROWS))
    doc_blocks = max(1, -(-stored.count() // DOC_BLOCK))

    def block(df: DataFrame, name: str, key: str, n: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        )

    left = block(asked, "_q", "query_id", query_blocks, "_d", doc_blocks)
    right = block(stored, "_d", "doc_id", doc_blocks, "_q", query_blocks)

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": [], by: []})
        scores = cosine(unit(q["embedding"]), unit(d["embedding"]))
        return best_of(q["query_id"].to_numpy(), d["doc_id"].to_numpy(), scores, k).assign(**{by: q[by].iloc[0]})

    keys = [by, "_q", "_d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, f"query_id bigint, doc_id bigint, score double, {by} string"
    )
