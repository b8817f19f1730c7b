"""Scores of token lists against a bounded set of token lists, in the tasks that read the rows.

The vocabulary of the bounded side is sent to the tasks. A task looks its tokens up in
it column-wise (Arrow), so neither tokens nor scored pairs are shuffled: per query only
the best rows of each task are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from veralytics import config as C
from veralytics.operators import vector_join
from veralytics.operators.vector_join import best_of, merge_best

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(vector_join)

ROW_BLOCK = 1_024
SCORE_DIGITS = 9


def _flat(column) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(list length per row, flat tokens, row number per token) of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lengths, lists.flatten(), np.repeat(np.arange(len(lengths)), lengths)


def nearest_by_words(rows: DataFrame, anchors: pd.DataFrame, by: str) -> DataFrame:
    """Rows with the best anchor of the same ``by`` by Jaccard of word sets.

    ``rows`` holds ``by`` and ``words`` (distinct); ``anchors`` (by, pos, question, words) is
    of bounded size. Adds best_probe and best_score; rows without anchors get nulls.
    """
    groups = {}
    for key, part in anchors.sort_values("pos").groupby(by):
        vocabulary = sorted({w for words in part["words"] for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        incidence = np.zeros((len(vocabulary) + 1, len(part)), np.float32)
        for j, words in enumerate(part["words"]):
            incidence[[number[w] for w in words], j] = 1.0
        sizes = part["words"].map(len).to_numpy(np.float64)
        groups[key] = (vocabulary, incidence, sizes, part["question"].tolist())
    sent = rows.sparkSession.sparkContext.broadcast(groups)
    kept = [c for c in rows.columns if c != "words"]
    schema = rows.drop("words").schema.add("best_probe", "string").add("best_score", "double")
    block = ROW_BLOCK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            domain = np.array(batch.column(names.index(by)).to_pylist(), dtype=object)
            best, score = np.full(len(domain), None, dtype=object), np.full(len(domain), np.nan)
            lengths, words, row = _flat(batch.column(names.index("words")))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for key in set(domain.tolist()) & set(sent.value):
                vocabulary, incidence, sizes, questions = sent.value[key]
                places = pc.fill_null(pc.index_in(words, value_set=pa.array(vocabulary, pa.string())), len(vocabulary))
                places = places.to_numpy(zero_copy_only=False)
                members = np.flatnonzero(domain == key)
                for at in range(0, len(members), block):
                    group = members[at : at + block]
                    shared = np.stack([incidence[places[starts[i] : starts[i + 1]]].sum(axis=0) for i in group]).astype(np.float64)
                    union = lengths[group][:, None] + sizes[None, :] - shared
                    jaccard = np.divide(shared, union, out=np.zeros_like(shared), where=(union > 0))
                    first = jaccard.argmax(axis=1)
                    best[group] = [questions[j] for j in first]
                    score[group] = jaccard[np.arange(len(first)), first]
            columns = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(best.tolist(), pa.string()), pa.array(score, pa.float64(), from_pandas=True)],
                names=[*kept, "best_probe", "best_score"],
            )

    return rows.mapInArrow(scan, schema)
