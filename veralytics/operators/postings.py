"""An inverted index in blocks, and BM25 search that skips blocks.

A block is a short run of documents as one task reads them, so building the index
moves nothing: a task counts the terms of a block and writes one row per term and
block, with the documents' counts and, for each count, the shortest document that has
it. From the latter alone follows the largest weight that the term has in the block,
for any mean length, so an index may be appended to.

A search deals the blocks to tasks. A task goes through its blocks one by one: the sum of
the largest weights of a query's terms bounds every score of a block, and a block that
cannot reach the k-th best score the task has found so far is skipped for that query. A
task holds one block, one chunk of queries and k documents for each of them. A frequent
word has a row in each block, so its rows are spread like all others and no task holds a
word's documents together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics import config as C
from veralytics.functions import text
from veralytics.operators import contains_join
from veralytics.operators.contains_join import runs
from veralytics.session import stored

# The functions of these modules travel to the tasks by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(contains_join)

# Documents of a block, and tokens after which a block ends early.
BLOCK_DOCS, BLOCK_TOKENS = 64, 100_000
# Terms of the queries of a chunk, and products that are held at a time.
CHUNK_TERMS, CELLS = 200_000, 1_000_000
SCORE_DIGITS = 9
# Above what the order of summation can change.
SLACK = 1e-6
# The row that counts a block's documents has the empty term, which no text has.
NO_TERM = ""
INDEX = (
    "term string, block bigint, n int, tokens bigint, bounds array<struct<tf: int, length: int>>,"
    " postings array<struct<doc_id: bigint, tf: int, length: int>>"
)


def _rows(ends: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """Lists of structs that end at the given places."""
    columns = [pa.array(v, pa.int64() if name == "doc_id" else pa.int32(), from_pandas=True) for name, v in fields.items()]
    return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))


def index_rows(block: int, doc_ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """The index rows of one block."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lengths) + doc, return_counts=True)
    term, doc = key // max(len(lengths), 1), key % max(len(lengths), 1)
    ends = np.flatnonzero(np.diff(term, append=-1)) + 1
    order = np.lexsort((lengths[doc], tf, term))  # for each term and count the shortest document
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(term[order]) != 0) | (np.diff(tf[order]) != 0)
    least = order[first]
    bound_ends = np.flatnonzero(np.diff(term[least], append=-1)) + 1
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(term[ends - 1])).cast(pa.string()), pa.array([NO_TERM])]),
        pa.array(np.full(len(ends) + 1, block)),
        pa.array([*np.diff(ends, prepend=0).tolist(), len(lengths)], pa.int32()),
        pa.array([*[0] * len(ends), int(lengths.sum())], pa.int64()),
        pa.concat_arrays([(b := _rows(bound_ends, {"tf": tf[least], "length": lengths[doc[least]]})), pa.array([[]], b.type)]),
        pa.concat_arrays([(p := _rows(ends, {"doc_id": doc_ids.to_numpy(zero_copy_only=False)[doc], "tf": tf, "length": lengths[doc]})), pa.array([[]], p.type)]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "tokens", "bounds", "postings"])


def block_index(docs: DataFrame) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text): term, block, n, tokens, bounds, postings.

    One row per term and block with its ``n`` documents in ``postings``; the row of the
    empty term has a block's number of documents and tokens. Blocks are numbered as they
    are read, so an index is written before it is used (``stored`` or a table of its own).
    Null texts and texts without terms count as documents of length 0; rows without a
    doc_id are left out. doc_id is the key of a document.
    """
    cut = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.tokenize(F.col("text")).alias("tokens"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            tokens = batch.column("tokens")
            held = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                most = (held[start - 1] if start else 0) + BLOCK_TOKENS
                end = min(start + BLOCK_DOCS, max(start + 1, int(np.searchsorted(held, most, side="right"))), batch.num_rows)
                yield index_rows(block, batch.column("doc_id").slice(start, end - start), tokens.slice(start, end - start))
                block, start = block + 1, end

    return cut.mapInArrow(build, INDEX)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length): how often each term is in each document."""
    return block_index(docs).where(F.col("term") != NO_TERM).select("term", F.inline("postings"))


def idf(documents: Column, with_term: Column) -> Column:
    """Always positive: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return F.log(1.0 + (documents - with_term + 0.5) / (with_term + 0.5))


def term_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    """Grows with ``tf`` and falls with ``length``."""
    return tf * (C.BM25_K1 + 1.0) / (tf + C.BM25_K1 * (1.0 - C.BM25_B + C.BM25_B * length / mean_length))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): each term of a query with its number of occurrences."""
    return (
        queries.select("query_id", F.explode(text.tokenize(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


class Asked:
    """The queries of one chunk with what is known of their best documents so far."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.ready = k, [], False

    def add(self, queries: pa.Array, terms: pa.Array, weights: pa.Array) -> None:
        self.parts.append((queries.to_numpy(zero_copy_only=False), terms, weights.to_numpy(zero_copy_only=False)))

    def _sort(self) -> None:
        queries, weights = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        coded = pa.concat_arrays([p[1] for p in self.parts]).dictionary_encode()
        order = np.argsort(queries, kind="stable")
        self.ids, self.query = np.unique(queries[order], return_inverse=True)
        self.term, self.weight = coded.indices.to_numpy(zero_copy_only=False)[order], weights[order]
        self.terms = coded.dictionary
        self.score = np.full((len(self.ids), self.k), -np.inf)
        self.doc = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.ready = True

    def meet(self, terms: pa.Array, best: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, weight: np.ndarray) -> int:
        """Score a block's documents for the queries whose bound reaches their threshold; returns how many these are."""
        if not self.ready:
            self._sort()
        at = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)[self.term]
        rows = np.flatnonzero(at >= 0)
        bound = np.bincount(self.query[rows], self.weight[rows] * best[at[rows]], len(self.ids))
        open_ = bound > np.maximum(self.score[:, -1] - SLACK, 0)
        rows = rows[open_[self.query[rows]]]
        if not len(rows):
            return 0
        docs, column = np.unique(doc_ids, return_inverse=True)
        own = np.zeros((len(ends), len(docs)))
        own[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), column] = weight
        chosen = np.flatnonzero(open_)
        scores = np.zeros((len(chosen), len(docs)))
        size = max(1, CELLS // len(docs))
        for start in range(0, len(rows), size):
            part = rows[start : start + size]
            first = np.flatnonzero(np.diff(self.query[part], prepend=-1))
            found = np.add.reduceat(self.weight[part, None] * own[at[part]], first, axis=0)
            scores[np.searchsorted(chosen, self.query[part][first])] += found
        scores = np.round(scores, SCORE_DIGITS)
        scores[scores <= 0] = -np.inf
        both = np.concatenate([self.score[chosen], scores], axis=1)
        names = np.concatenate([self.doc[chosen], np.broadcast_to(docs, scores.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.score[chosen] = np.take_along_axis(both, order, 1)
        self.doc[chosen] = np.take_along_axis(names, order, 1)
        return len(chosen)

    def found(self) -> pa.RecordBatch:
        if not self.ready:
            return pa.RecordBatch.from_pydict({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query, place = np.nonzero(np.isfinite(self.score))
        columns = [pa.array(self.ids[query]), pa.array(self.doc[query, place]), pa.array(self.score[query, place])]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "score"])


def search_index(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Top k documents per query by BM25 over a stored index: (query_id, doc_id, score, rank).

    ``queries`` (query_id, query). Documents without any term of a query are not found;
    ties go to the smaller doc_id.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    terms = stored(query_terms(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query")))
    documents, tokens = index.where(F.col("term") == NO_TERM).agg(F.sum("n"), F.sum("tokens")).first()
    chunks = max(1, -(-terms.count() // CHUNK_TERMS))
    mean = tokens / documents if tokens else 1.0
    lists = index.where(F.col("term") != NO_TERM)
    known = lists.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("_df"))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
    weight = (F.col("qtf") * idf(F.lit(documents or 0), F.col("_df"))).alias("weight")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = stored(terms.join(known, "term").select(chunk, "query_id", "term", weight))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = asked.select("chunk", each_part, F.lit(0).cast("bigint").alias("place"), "term", "query_id", "weight", null("double", "best"), null(INDEX.split("postings ")[1], "postings"))
    best = F.array_max(F.transform("bounds", lambda b: term_weight(b["tf"], b["length"], F.lit(mean)))).alias("best")
    # A frequent term has rows in all blocks: they are joined part by part.
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    rows = lists.select("term", part, (F.col("block") + 1).alias("place"), best, "postings")
    right = rows.join(asked.select("term", "chunk").distinct().select("*", each_part), ["term", "part"])
    right = right.select("chunk", "part", "place", "term", null("bigint", "query_id"), null("double", "weight"), "best", "postings")
    both = left.union(right).repartition(parts, "chunk", "part").sortWithinPartitions("chunk", "part", "place")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, key = None, [], None

        def meet() -> None:
            """The block whose rows are held."""
            terms = pa.concat_arrays([b.column("term") for b in held])
            best = np.concatenate([b.column("best").to_numpy(zero_copy_only=False) for b in held])
            docs = pa.concat_arrays([b.column("postings") for b in held])
            flat = docs.flatten()
            doc_ids, tf, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            weight = tf * (C.BM25_K1 + 1.0) / (tf + C.BM25_K1 * (1.0 - C.BM25_B + C.BM25_B * length / mean))
            now.meet(terms, best, np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False)), doc_ids, weight)
            held.clear()

        for batch in batches:
            for start, end in runs(batch, ("chunk", "part", "place")):
                at = tuple(batch.column(c)[start].as_py() for c in ("chunk", "part", "place"))
                if at != key and held:
                    meet()
                if key is None or at[:2] != key[:2]:
                    if now is not None:
                        yield now.found()
                    now = Asked(k)
                key, rows = at, batch.slice(start, end - start)
                if at[2] == 0:
                    now.add(rows.column("query_id"), rows.column("term"), rows.column("weight"))
                else:
                    held.append(rows)
        if held:
            meet()
        if now is not None:
            yield now.found()

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = both.mapInArrow(solve, "query_id bigint, doc_id bigint, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The same over documents (doc_id, text), which are read once; only rows of the queries' terms are kept."""
    wanted = query_terms(queries).select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(NO_TERM)))
    return search_index(queries, stored(block_index(docs).join(stored(wanted), "term", "left_semi")), k)
