"""N-gram Jaccard join as an exact join in the metric space of shingle sets.

``1 - Jaccard`` is a metric, so distances to a pivot bound the distance of two
sets. Between unrelated sets it is 1 almost everywhere and bounds nothing, so
pivots are chosen where they say something: two linked sets share one of their
rarest shingles (by any one order of shingles). Of the sets that share such a
shingle, those that their sizes and the shingle's place in them leave linkable
form a region around one of them, the pivot. Shingles are moved once, and only
regions of several sets come out.

Most sets of a region are still far apart. Counts of a set's shingles by hash, a small
fraction of its size, bound the distance of two sets from below; sets that this
bound leaves near each other form a family, and a family's sets are read once.

Inside a family only pairs whose distances to its pivot differ by no more than
the threshold can be linked. A family of bounded size is solved in one task. A
larger one is joined again and again with further pivots: sets linked with a
pivot fall into its component and need no comparison with each other; those
outside the family's largest component are left, choose the next pivots, and in
the end meet the family's other sets block by block, where a set is copied to a
block only if its distances to all pivots allow a link (triangle inequality).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import kept, packed, sliced
from veralytics.llm.components import components
from veralytics.llm.id_bits import bitmap, hits, parted
from veralytics.llm.shingles import fingerprint, shingle_sets

WORDS, PERCENT = 3, 90
# Counts by hash that order the shingles; every task holds 2**COUNT_BITS of them.
COUNT_BITS, COUNT_PARTS = 18, 64
# Sets of a family, or of one side of two blocks, that one task compares, and their shingles together; sketches of a region.
BLOCK, BLOCK_SHINGLES, REGION = 2048, 4_000_000, 2048
# Rows (sketches) or shingles (sets) that one call inside a task takes, as whole regions or families.
CALL_ROWS, CALL_SHINGLES = 4000, 1_000_000
# Shingles of a family that one step of a call compares with 64 of its sets.
STEP_SHINGLES = 500_000
# A set's shingles are counted in 2**k buckets that hold this many of them at least on average.
PER_BUCKET = 4
ROUNDS = 4
COLUMNS = 8192


def _bucket(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(left), len(right)))
    if not left or not right:
        return out.astype(np.int64)
    if len(left) == 1 or len(right) == 1:
        one, many = (left[0], right) if len(left) == 1 else (right[0], left)
        sizes = [int(np.isin(s, one, assume_unique=True).sum()) for s in many]
        return np.array(sizes, np.int64).reshape(out.shape)
    value = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    code = pd.factorize(value)[0]
    seen = np.bincount(code) > 1  # the others add nothing
    column = (np.cumsum(seen) - 1)[code]
    keep = seen[code]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(seen.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Numbers of a set's shingles by the first bits of their hashes, 255 at most."""
    k = max(0, len(own) // PER_BUCKET).bit_length() - 1
    if k <= 0:
        return np.array([min(len(own), 255)], np.uint8)
    return np.minimum(np.bincount((own >> np.uint64(64 - k)).astype(np.int64), minlength=2**k), 255).astype(np.uint8)


# Bits of the second of two numbers that a span holds.
FAR_BITS = 31


def place_spans(size: int, percent: int) -> np.ndarray:
    """Per place in a set's order, from its rarest shingle on, which sets may be linked when that is their first shared shingle.

    With ``place`` shingles before it the intersection is at most ``size - place``, which
    bounds the other set's size. Two sets may be linked only if neither is larger than the
    other's bound: a set whose bound is its size or more is an interval (size, bound) and meets
    the intervals that overlap with it, any other lies inside those that it meets. A span holds
    twice the lower end, plus 1 for a set of the second kind, then the upper end.
    """
    n = size - -(-size * percent // 100) + 1
    bound = np.minimum((100 + percent) * (size - np.arange(n)) // percent - size, 2**FAR_BITS - 1)
    return (2 * np.minimum(bound, size) + (bound < size) << FAR_BITS) + np.maximum(bound, size)


def clustered(token: np.ndarray, node: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """(lead, node) of sets of one token that spans join, sorted by (token, span, node); a set joined with none is left out.

    The last value is a row that stands for all rows of the last token when more of them follow.
    """
    low, far = span >> (FAR_BITS + 1), span & (2**FAR_BITS - 1)
    whole = (span >> FAR_BITS) & 1 == 0
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) << (FAR_BITS + 1)
    reached = np.maximum.accumulate(group + np.where(whole, far + 1, 0))
    # The highest end of the token's intervals so far; -1 if there are none.
    before = np.maximum(np.concatenate([[0], reached[:-1]]) - group, 0) - 1
    first = whole & (before < low)
    cluster = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    twin = np.concatenate([[False], (group[1:] == group[:-1]) & (node[1:] == node[:-1]) & (span[1:] == span[:-1])])
    member = np.flatnonzero((whole | (before >= far)) & ~twin)
    member = member[np.bincount(cluster[member], minlength=len(heads))[cluster[member]] > 1]
    end = int(reached[-1] - group[-1]) - 1
    head = heads[-1] if end >= 0 else None
    state = None if head is None else (token[head], node[head], (low[head] << (FAR_BITS + 1)) + end)
    return node[heads[cluster[member]]], node[member], state


def near_pairs(region: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the pairs that sizes and sketches leave possible.

    The distance of two sketches is no more than the size of the sets' symmetric
    difference; a finer sketch is added up to the coarser one's buckets first.
    """
    region = region.sort_values(["n_shingles", "node"])
    nodes, size = region["node"].to_numpy(), region["n_shingles"].to_numpy()
    fine = [np.frombuffer(s, np.uint8).astype(np.int32) for s in region["sketch"]]
    level = np.array([len(s) for s in fine])
    group, stacked = np.arange(len(nodes)), {}

    def at(k: int) -> np.ndarray:
        """All sketches of at least ``k`` buckets, with ``k`` buckets; those of fewer buckets as zeros."""
        if k not in stacked:
            rows = [s.reshape(k, -1).sum(1) if len(s) >= k else np.zeros(k, np.int32) for s in fine]
            stacked[k] = np.stack(rows)
        return stacked[k]

    for i in range(len(nodes) - 1):
        end = np.searchsorted(size, size[i] * 100 // percent, side="right")
        if end <= i + 1:
            continue
        others = i + 1 + np.flatnonzero(group[i + 1 : end] != group[i])
        if not len(others):
            continue
        own = at(int(level[i:end].min()))
        gap = np.abs(own[others] - own[i]).sum(1)
        for j in others[linked((size[others] + size[i] - gap) // 2, size[i], size[others], percent)]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    return stars(nodes, group)


def stars(nodes: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """A link from each node to the smallest of its group."""
    least = pd.Series(nodes).groupby(group).transform("min").to_numpy()
    return [(a, b) for a, b in zip(nodes, least, strict=True) if a != b]


class Forest:
    """Components inside one task."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


def solve_family(region: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a family; its pivot is the smallest node."""
    nodes, sets = region["node"].to_numpy(), _sets(region["shingles"])
    size = np.array([len(s) for s in sets])
    pivot = int(np.argmin(nodes))
    inter = intersections([sets[pivot]], sets)[0]
    far = 1 - inter / (size + size[pivot] - inter)
    order = np.argsort(far, kind="stable")
    group = np.arange(len(nodes))
    reach = 1 - percent / 100 + 1e-9
    for start in range(0, len(order), 64):
        rows = order[start : start + 64]
        others = order[start : np.searchsorted(far[order], far[rows[-1]] + reach, side="right")]
        if len(np.unique(group[others])) < 2:
            continue
        held = np.cumsum(size[others]) // STEP_SHINGLES
        for part in np.split(others, np.flatnonzero(np.diff(held)) + 1):
            found = intersections([sets[i] for i in rows], [sets[i] for i in part])
            for i, j in zip(*np.nonzero(linked(found, size[rows][:, None], size[part][None, :], percent)), strict=True):
                a, b = group[rows[i]], group[part[j]]
                if a != b:
                    group[group == b] = a
    return stars(nodes, group)


def _pairs(rows) -> pd.DataFrame:
    return pd.DataFrame({"a": [int(a) for a, _ in rows], "b": [int(b) for _, b in rows]}, dtype=np.int64)


def _each(rows: DataFrame, calls: int, solve, once: str | None = None) -> DataFrame:
    """``solve`` over each lead's rows, with many leads to a call; its pairs as (a, b). ``once``: a column whose first value per node is taken."""

    def call(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lead", ignore_index=True)
        edges = np.flatnonzero(np.diff(part["lead"].to_numpy(), prepend=part["lead"].iloc[0])) if len(part) else []
        return _pairs([p for a, b in zip([0, *edges], [*edges, len(part)], strict=True) for p in solve(part.iloc[a:b])])

    rows = rows.withColumn("call", F.pmod(F.xxhash64("lead"), F.lit(max(1, calls))))
    rows = _spread(rows, "call")
    if once:
        rows = rows.groupBy("call", "lead", "node").agg(F.first(once).alias(once))
    return rows.groupBy("call").applyInPandas(call, "a long, b long")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """As many partitions as the cluster's setting says: these rows cost time, not bytes, so they are not put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Join:
    """The join of one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
        self.words, self.percent = words, percent
        self.named, self.counts = self._names()

    def _names(self) -> tuple[DataFrame, np.ndarray]:
        """doc_id, n_shingles, node (the set's name) and sketch of all rows, and the counts that order the shingles."""
        words, step = self.words, 2**COUNT_BITS // COUNT_PARTS

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        columns = ["doc_id", "n_shingles", "node", "sketch", "part", "counts"]

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(2**COUNT_BITS, np.int64)
            for batch in batches:
                for part, texts in sliced(batch):
                    sets = list(shingle_sets(texts, words))
                    counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts))
                    size = [len(own) for own in sets]
                    node = [fingerprint(own) if len(own) else None for own in sets]
                    marks = [sketch(own).tobytes() for own in sets]
                    rest = [None] * len(sets)
                    values = [part.column("doc_id").to_pylist(), size, node, marks, rest, rest]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], columns)
            parts = [counts[i * step : (i + 1) * step].tobytes() for i in range(COUNT_PARTS)]
            values = [*[[None] * COUNT_PARTS] * 4, range(COUNT_PARTS), parts]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], columns)

        def total(key, rows: pd.DataFrame) -> pd.DataFrame:
            sums = np.sum([np.frombuffer(b, np.int64) for b in rows["counts"]], axis=0)
            return pd.DataFrame({"part": [key[0]], "counts": [sums.tobytes()]})

        both = kept(self.docs.mapInArrow(name, "doc_id long, n_shingles long, node long, sketch binary, part int, counts binary"))
        rows = both.where("part IS NOT NULL").groupBy("part").applyInPandas(total, "part int, counts binary").collect()
        counts = np.zeros((COUNT_PARTS, step), np.int64)
        for r in rows:  # COUNT_PARTS rows of fixed size
            counts[r["part"]] = np.frombuffer(r["counts"], np.int64)
        return both.where("part IS NULL").drop("part", "counts"), counts.ravel()

    def _regions(self) -> DataFrame:
        """(lead, node): the sets that share a shingle of their prefixes with the pivot ``lead`` and may be linked, itself included."""
        words, percent, counts = self.words, self.percent, self.counts

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()  # of this task's rows
            for texts in (texts for batch in batches for _, texts in sliced(batch)):
                token, node, span = [], [], []
                for own in shingle_sets(texts, words):
                    name = fingerprint(own) if len(own) else None
                    if name is None or name in done:
                        continue
                    done.add(name)
                    span.append(place_spans(len(own), percent))
                    rare = np.lexsort((own, counts[_bucket(own)]))[: len(span[-1])]
                    token.append(own[rare].view(np.int64))
                    node.append(np.full(len(rare), name, np.int64))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, node, span)], ["token", "node", "span"])

        def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                rows = [c.to_numpy() for c in batch.columns]
                if state:
                    rows = [np.concatenate([[x], c]) for x, c in zip(state, rows, strict=True)]
                if len(rows[0]):
                    lead, node, state = clustered(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(node)], ["lead", "node"])

        tokens = self.docs.where("doc_id IS NOT NULL").mapInArrow(prefixes, "token long, node long, span long")
        tokens = _spread(tokens, "token").sortWithinPartitions("token", "span", "node")
        return kept(tokens.mapInArrow(regions, "lead long, node long").distinct())

    def _families(self) -> DataFrame:
        """(lead, node): families of sets that may be near each other, named by their smallest member."""
        percent, regions = self.percent, self._regions()
        sketches = self.named.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        size = kept(regions.groupBy("lead").agg(F.count("*").alias("size")))
        calls = int(size.agg(F.sum("size")).first()[0] or 0) // CALL_ROWS
        rows = regions.join(size.where(F.col("size") <= REGION).select("lead"), "lead").join(sketches, "node")
        large = regions.join(size.where(F.col("size") > REGION).select("lead"), "lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        parts = components(_each(rows, calls, lambda region: near_pairs(region, percent)).union(large))
        return kept(parts.select(F.col("component").alias("lead"), "node"))

    def _members(self, families: DataFrame) -> DataFrame:
        """lead, node, doc_id (of the document that the set is read from) and n (its shingles) of all sets in families."""
        named = self.named.where("doc_id IS NOT NULL AND node IS NOT NULL")
        first = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
        return kept(families.join(first, "node").select("lead", "node", "doc_id", "n"))

    def _shingles(self, members: DataFrame) -> DataFrame:
        """``members`` with shingles (so many sorted hashes as bytes); a task gives a row at most for each member, of its documents."""
        words = self.words
        bits = bitmap(members.select(F.col("doc_id").alias("id")))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[tuple[int, int]] = set()
            found = (batch.filter(pa.array(hits(bits, batch.column("doc_id")))) for batch in batches)
            for own, texts in (part for batch in found for part in sliced(batch)):
                sets = list(shingle_sets(texts, words))
                keys = [(i, fingerprint(s)) if len(s) else None for i, s in zip(own.column("doc_id").to_pylist(), sets, strict=True)]
                new = {k: s for k, s in zip(keys, sets, strict=True) if k and k not in done}
                done.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in new], pa.int64()), pa.array([n for _, n in new], pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())],
                    ["doc_id", "node", "shingles"],
                )

        return self.docs.mapInArrow(read, "doc_id long, node long, shingles binary").join(members, ["doc_id", "node"])

    def links(self) -> DataFrame:
        """(a, b): links between different sets, enough to join each component; copies of a set share its node."""
        percent = self.percent
        members = self._members(self._families())
        size = members.groupBy("lead").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.max("node").alias("top"))
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int")
        size = kept(size.withColumn("blocks", blocks))
        small = members.join(size.where("blocks = 1").select("lead"), "lead")
        calls = int(size.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // CALL_SHINGLES
        found = kept(_each(self._shingles(small), calls, lambda family: solve_family(family, percent), once="shingles"))
        large = size.where("blocks > 1").drop("n")
        if large.isEmpty():
            return found
        sets = self._shingles(members.join(large, "lead")).groupBy("node").agg(
            *[F.first(c).alias(c) for c in ("lead", "blocks", "shingles")]
        )
        return self._large(kept(sets), large, found)

    def _large(self, sets: DataFrame, large: DataFrame, found: DataFrame) -> DataFrame:
        """Links of families that no single task compares; ``found`` are the links known so far."""
        percent, reach = self.percent, 1 - self.percent / 100 + 1e-9
        rows = sets.select("lead", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "shingles")
        pivots = large.select("lead", "blocks", F.explode(F.array("lead", "top")).alias("node"))
        far = rows.select("lead", "node", "blocks", "block", F.array().cast("array<double>").alias("far"))
        left = None
        for round_no in range(ROUNDS):
            chosen = pivots.distinct().join(sets.select("node", "shingles"), "node").select(
                F.col("lead").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"),
                F.col("node").alias("pivot"), F.col("shingles").alias("own"),
            )

            def measure(block: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
                pivots = pivots.sort_values("pivot")
                sets, own = _sets(block["shingles"]), _sets(pivots["own"])
                a, b = np.array([len(s) for s in sets])[:, None], np.array([len(s) for s in own])[None, :]
                inter = intersections(sets, own)
                near = linked(inter, a, b, percent)
                return pd.DataFrame({
                    "lead": block["lead"], "node": block["node"], "more": list(1 - inter / np.maximum(a + b - inter, 1)),
                    "near": [pivots["pivot"].to_numpy()[n].tolist() for n in near],
                })

            measured = kept(
                rows.groupBy("lead", "block").cogroup(chosen.groupBy("to", "to_block"))
                .applyInPandas(measure, "lead long, node long, more array<double>, near array<long>")
            )
            far = kept(far.join(measured, ["lead", "node"]).select("lead", "node", "blocks", "block", F.concat("far", "more").alias("far")))
            found = kept(found.union(measured.select(F.col("node").alias("a"), F.explode("near").alias("b")).where("a <> b")))
            parts = components(found)
            placed = kept(far.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
            heads = placed.groupBy("lead", "component").count().groupBy("lead").agg(F.max_by("component", F.struct("count", "component")).alias("head"))
            left = kept(placed.join(heads, "lead").where("component <> head").drop("head"))
            open_ = left.groupBy("lead", "blocks").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y"))
            pivots = kept(open_.where(F.col("n") > BLOCK).select("lead", "blocks", F.explode(F.array("x", "y")).alias("node")))
            if pivots.isEmpty():
                break
            rows_open = pivots.select("lead").distinct()
            if round_no + 1 < ROUNDS:
                pivots = pivots.union(large.join(rows_open, "lead", "left_anti").select("lead", "blocks", F.col("lead").alias("node")))
        return self._blocks(rows, far, left, found, reach)

    def _blocks(self, rows: DataFrame, far: DataFrame, left: DataFrame, found: DataFrame, reach: float) -> DataFrame:
        """The sets that are left against all sets of their family, in blocks."""
        percent = self.percent
        count = left.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
        left = left.join(count, "lead").withColumn("ask", F.pmod(F.xxhash64("node", F.lit(1)), "asks").cast("int"))
        # Per block of asking sets the span of their distances to each pivot.
        spans = left.select("lead", "ask", F.posexplode("far").alias("p", "d")).groupBy("lead", "ask", "p").agg(
            F.min("d").alias("low"), F.max("d").alias("high")
        )
        spans = kept(spans.groupBy("lead", "ask").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("span")))
        near = F.forall(
            F.zip_with("span", "far", lambda s, d: (d >= s["low"] - reach) & (d <= s["high"] + reach)), lambda x: x
        )
        others = far.join(spans, "lead").where(near).select("lead", "node", "block", "ask")
        others = others.join(rows.select("lead", "node", "shingles"), ["lead", "node"]).select(
            F.col("lead").alias("to"), F.col("block").alias("to_block"), F.col("ask").alias("to_ask"), F.col("node").alias("other"), F.col("shingles").alias("own")
        )
        asking = left.join(rows.select("lead", "node", "shingles"), ["lead", "node"]).select(
            "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ask", "node", "shingles"
        )

        def compare(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            a, b = _sets(asks["shingles"]), _sets(block["own"])
            x, y = asks["node"].to_numpy(), block["other"].to_numpy()
            hit = linked(
                intersections(a, b), np.array([len(s) for s in a], np.int64)[:, None], np.array([len(s) for s in b], np.int64)[None, :], percent
            )
            forest, out = Forest([*x, *y]), []
            for i, j in zip(*np.nonzero(hit), strict=True):
                if x[i] != y[j] and forest.join(x[i], y[j]):
                    out.append((x[i], y[j]))
            return _pairs(out)

        more = asking.groupBy("lead", "block", "ask").cogroup(others.groupBy("to", "to_block", "to_ask"))
        return found.union(more.applyInPandas(compare, "a long, b long"))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        first = self.named.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
        parts = kept(components(self.links()).join(first, "node"))
        joined = parts.groupBy("component").agg(F.min("first").alias("component_id"))
        by_node = parts.join(joined, "component").select("node", "component_id")
        ids = kept(first.join(by_node, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")))
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
        return self.named.join(ids, "node", "left").select("doc_id", "n_shingles", own)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (smallest doc_id reachable by links), one row per row.

    Two documents are linked when the Jaccard similarity of their sets of
    ``words``-word shingles is at least ``percent`` %. Null texts and texts without
    words have empty sets and are linked with nothing. Copies share a set and are
    linked with each other. Rows with a null doc_id get their set's size and no
    component. Repeated doc_ids are rows of their own with one name. Only doc_id
    and text are read; an empty table gives no rows.

    Sets are told apart by 64-bit hashes of their shingles.
    """
    return Join(docs, words, percent).classes()


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of its component.

    Documents without words and rows with a null doc_id stay. Of rows that repeat a
    doc_id of a document with words one stays. Texts are not shuffled: a bitmap of
    fixed size passes by all but the few rows whose doc_id may have to go.
    """
    classes = kept(join(docs, words, percent))
    alike = classes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = alike.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("twice"))
    lesser = alike.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.lit(False).alias("twice")).distinct()
    found = kept(lesser.union(twice).groupBy("id").agg(F.min("twice").alias("twice")))
    maybe, sure = parted(docs, bitmap(found))
    names = docs.columns
    looked_up = maybe.select(packed(maybe).alias("row"), maybe["doc_id"].cast("long").alias("key"))
    looked_up = looked_up.join(found, F.col("key") == F.col("id"), "left").where("twice IS NULL OR twice")
    # Maps have no order, their text has.
    smallest = F.min_by("row", F.to_json("row")) if '"type":"map"' in docs.schema.json() else F.min("row")
    repeated = looked_up.where("twice").groupBy("key").agg(smallest.alias("row"))
    rows = looked_up.where("twice IS NULL").select("row").union(repeated.select("row"))
    return sure.union(rows.select(*[F.col("row")[c].alias(c) for c in names]))
