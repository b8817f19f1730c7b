"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on one feature at a time, in turn, on a bounded
labelled sample; their sum per feature is a lookup table over its bins. The
pairs of features that explain most of what is left get tables of their own.
Scoring adds the entries of a row's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import kept
from veralytics.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample
from veralytics.llm.quality_rules import bin_edges, stats_table
from veralytics.llm.text_stats import FEATURES

BINS, PAIR_BINS, PAIRS, CYCLES, PAIR_CYCLES, RATE, RIDGE = 32, 8, 8, 60, 20, 0.15, 2.0
LEAST_SCORE = 0.7


@dataclass
class Additive:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability that each row is good: the start value plus one entry per table."""
        out = np.full(len(x), self.start)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            out += t[np.searchsorted(e, c)]
        binned = [np.searchsorted(e, c) for e, c in zip(self.pair_edges, x.T, strict=True)]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[binned[i], binned[j]]
        return 1 / (1 + np.exp(-out))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """The bin after which one cut explains most."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    return int(np.argmax(_gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl))) + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of ``depth`` cuts over a feature's bins, as the value of each bin."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    k = _cut(g, h)
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two crossing cuts of a pair's bins: what they explain, and the value of each bin."""
    cum = lambda a: np.cumsum(np.cumsum(a, 0), 1)
    cg, ch = cum(g), cum(h)
    parts = lambda c: (
        c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1],
        c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1],
    )
    pg, ph = parts(cg), parts(ch)
    total = sum(_gain(a, b) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(np.argmax(total), total.shape)
    v = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(pg, ph, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(total[i, j]), out


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit the tables. Without rows of both labels every score is the base rate (0.5 without rows)."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    n = x.shape[1]
    if len(np.unique(y)) < 2:
        return Additive(start, [np.zeros(0)] * n, [np.zeros(1)] * n, [np.zeros(0)] * n, [], [])
    edges, pair_edges = bin_edges(x, BINS), bin_edges(x, PAIR_BINS)
    bins = [np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    raw = np.full(len(y), start)
    for _ in range(CYCLES):
        for f in range(n):
            p = 1 / (1 + np.exp(-raw))
            size = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            tables[f] += step
            raw += step[bins[f]]
    coarse = [np.searchsorted(e, c) for e, c in zip(pair_edges, x.T, strict=True)]
    size = [len(e) + 1 for e in pair_edges]

    def histograms(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = 1 / (1 + np.exp(-raw)), coarse[i] * size[j] + coarse[j]
        full = lambda w: np.bincount(cell, w, size[i] * size[j]).reshape(size[i], size[j])
        return full(y - p), full(p * (1 - p))

    able = [(i, j) for i, j in combinations(range(n), 2) if size[i] > 1 and size[j] > 1]
    pairs = sorted(able, key=lambda ij: -_quadrants(*histograms(*ij))[0])[:PAIRS]
    pair_tables = [np.zeros((size[i], size[j])) for i, j in pairs]
    for _ in range(PAIR_CYCLES):
        for t, (i, j) in zip(pair_tables, pairs, strict=True):
            step = RATE * _quadrants(*histograms(i, j))[1]
            t += step
            raw += step[coarse[i], coarse[j]]
    return Additive(start, edges, tables, pair_edges, pairs, pair_tables)


def classify(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted; one row per row of ``docs``.

    Inputs of a score are statistics of the whole text alone. Null and empty texts
    are scored as texts without words. Repeated rows get equal scores. A null
    doc_id is not held out. Other columns are not read, so their names cannot
    clash. An empty table gives no rows. The model is fitted on at most ``rows``
    labelled documents that are not held out.
    """
    stats = kept(stats_table(docs))
    sample = labelled_sample(stats, labels, "quality", rows).select(*FEATURES, "y").toPandas()
    model = boost(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(batch[FEATURES].to_numpy(float))})

    return stats.mapInPandas(score, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least_score).cast("int").alias("predicted"),
    )
