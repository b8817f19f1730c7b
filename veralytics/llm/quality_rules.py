"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded labelled sample, with monotonic
constraints on chosen features, and flattened into node arrays. Scoring walks
all rows of a batch through all trees at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm import sentencepiece
from veralytics.llm.common import kept, sliced
from veralytics.llm.labelled import SAMPLE_ROWS, labelled_sample
from veralytics.llm.text_stats import BASE, FEATURES, text_stats

# -1: more of it never raises the score.
MONOTONE = {
    "symbol_rate": -1, "exclaim_rate": -1, "pipe_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1,
    "top_word_rate": -1, "same_next_rate": -1,
}
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 64, 20, 1.0
LEAST_SCORE = 0.4
FEWEST_WORDS, MOST_REPEATS = 20, 30


@dataclass
class Forest:
    """Node arrays of shape (trees, nodes); leaves are full depth, ``value`` is read at the end."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability that each row is good."""
        trees = np.arange(self.feature.shape[0])
        out = np.empty(len(x))
        for s in range(0, len(x), 4096):
            rows = x[s : s + 4096]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(DEPTH):
                right = rows[np.arange(len(rows))[:, None], self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            out[s : s + 4096] = self.start + self.value[trees, node].sum(1)
        return 1 / (1 + np.exp(-out))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts between quantiles of each column; values above the last cut form the last bin."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _best_split(hist: np.ndarray, sign: np.ndarray, low: float, high: float, n_bins: np.ndarray):
    """(gain, feature, bin) of the best cut of a node; ``hist`` holds gradient, hessian, rows by feature and bin."""
    left = np.cumsum(hist, axis=2)
    right = left[:, :, -1:] - left
    value = lambda h: np.clip(h[0] / (h[1] + RIDGE), low, high)
    worth = lambda h, v: h[0] * v - 0.5 * (h[1] + RIDGE) * v * v
    lv, rv, whole = value(left), value(right), left[:, 0, -1]
    gain = worth(left, lv) + worth(right, rv) - worth(whole, value(whole))
    ok = (left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS) & (sign[:, None] * (rv - lv) >= 0)
    ok &= np.arange(hist.shape[2])[None, :] < n_bins[:, None] - 1
    gain = np.where(ok, gain, 0)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return gain[f, b], f, b, lv[f, b], rv[f, b]


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> Forest:
    """Boosted trees for log loss; a constraint also bounds the values below each split by their mid value."""
    inner, nodes = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    feature, cut = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf)
    value = np.zeros((TREES, nodes))
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Forest(start, feature, cut, value)
    edges = bin_edges(x, BINS)
    n_bins = np.array([len(e) + 1 for e in edges])
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    offset = binned + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-4.0, 4.0)}
        value[t, 0] = np.clip(g.sum() / (h.sum() + RIDGE), -4, 4)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            low, high = bounds.get(k, (-4.0, 4.0))
            flat = offset[rows].ravel()
            each = lambda w: np.bincount(flat, np.repeat(w, x.shape[1]), x.shape[1] * BINS)  # noqa: E731, B023
            hist = np.stack([each(g[rows]), each(h[rows]), each(np.ones(len(rows)))]).reshape(3, x.shape[1], BINS)
            gain, f, b, lv, rv = _best_split(hist, monotone, low, high, n_bins) if len(rows) else (0, 0, 0, 0, 0)
            left, right = 2 * k + 1, 2 * k + 2
            if gain <= 1e-6:  # all rows go left, with the node's own value
                value[t, left] = value[t, k]
                bounds[left] = (low, high)
                node[rows] = left
                continue
            feature[t, k], cut[t, k] = f, edges[f][b]
            mid = (lv + rv) / 2
            bounds[left] = (low, mid) if monotone[f] > 0 else (mid, high) if monotone[f] < 0 else (low, high)
            bounds[right] = (mid, high) if monotone[f] > 0 else (low, mid) if monotone[f] < 0 else (low, high)
            value[t, left], value[t, right] = lv, rv
            node[rows] = np.where(binned[rows, f] <= b, left, right)
        value[t] *= RATE
        raw += value[t, node]
    return Forest(start, feature, cut, value)


def stats_table(docs: DataFrame) -> DataFrame:
    """Statistics of every document: doc_id, the counts of ``BASE`` and the measures of ``FEATURES``."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), text_stats(batch["text"].tolist())], axis=1)

    schema = "doc_id long, " + ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(stats, schema)


def fit(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    sample = labelled_sample(stats, labels, "quality", rows).select(*FEATURES, "y").toPandas()
    monotone = np.array([MONOTONE.get(c, 0) for c in FEATURES])
    return grow(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float), monotone)


def failed(stats: pd.DataFrame) -> pd.Series:
    """The base rules: too few words, or too many of them repeated."""
    few = stats["n_words"] < FEWEST_WORDS
    return few | (100 * stats["n_repeat_words"] > MOST_REPEATS * stats["n_words"])


def judge(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base rules and the trees' verdict, one row per row of ``docs``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words inside windows
    of eight words that occur twice or more in the text. ``kept``: not failed, and
    the trees give at least ``least_score``.

    Null and empty texts have no words and fail. Repeated rows are judged alike,
    each on its own; a null doc_id passes through. Without labelled rows of both
    kinds the trees give the base rate (0.5 without rows), so only the base rules
    decide where that is high enough. Other columns are not read, so their names
    cannot clash. An empty table gives no rows. The model is fitted on at most
    ``rows`` labelled documents.
    """
    stats = kept(stats_table(docs))
    forest = fit(stats, labels, rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", *BASE]].copy()
            out["base_failed"] = failed(batch)
            out["score"] = forest.score(batch[FEATURES].to_numpy(float))
            out["kept"] = ~out["base_failed"] & (out["score"] >= least_score)
            yield out

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE)
    return stats.mapInPandas(score, f"{schema}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are.

    Verdicts are those of :func:`judge`; of the texts, only those of at most ``rows``
    labelled documents are read before the pass that filters.
    """
    chosen = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")), labels, "quality", rows)  # as judge draws it: labels of other documents do not count
    train = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    forest = fit(kept(stats_table(train)), labels, rows)

    def good(text: pa.Array) -> pa.Array:
        sentencepiece.Encoder.kept.clear()  # a worker that has encoded before need not hold its words through other stages
        keep = [np.zeros(0, bool)]
        for _, texts in sliced(pa.RecordBatch.from_arrays([text], ["text"])):
            stats = text_stats(texts)
            keep.append((~failed(stats) & (forest.score(stats[FEATURES].to_numpy(float)) >= least_score)).to_numpy())
        return pa.array(np.concatenate(keep))

    return docs.where(F.arrow_udf(good, "boolean")(docs["text"]))
