"""Exact top-k by integer inner product as a Voronoi kNN join.

Vectors and queries are grouped by their nearest pivot. For a query q and a
vector x of the cell of pivot p, ``q.x <= q.p + |q| |x - p|``. Scores against a
bounded sample of the vectors give each query a score that its k-th best result
reaches at least, so a group of queries needs only those vectors of a cell that
lie far enough from the pivot. Neighbouring cells with few queries form one group,
so that few groups ask for copies. Each vector is copied to the groups that need
it, in blocks of bounded size, and groups are solved block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veralytics.llm.common import kept

K = 10
SCALE = 1024
QUERY_STEP = 100
# Vectors of the sample and pivots among them; both are held by every task.
SAMPLE, PIVOTS = 2048, 32
QUERY_BLOCK, DATA_BLOCK = 4096, 8192
# Queries of a block that a task scores at a time.
STEP = 512
VEC = "row long, vec_id long, v array<long>"
LEAST, MOST = -(2**63), 2**63 - 1


def as_integers(vectors: DataFrame) -> DataFrame:
    """row (a number of its own for each row), vec_id and v: floor(1024 * x) of each component as integers.

    Vectors that are null or hold null or non-finite components are left out, and
    so are rows with a null vec_id. Rows that repeat a vec_id stay rows of their own.
    Integers beyond a long become the nearest long.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(F.col("embedding"), fine)
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    own = vectors.select("vec_id", "embedding").where(whole)
    return own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    """Vectors as rows; a shorter one counts as filled up with zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, at most the largest and at least the smallest long; floating-point ones where every sum fits their mantissa."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(float), b.astype(float)
    if np.abs(x).max() * np.abs(y).max() * a.shape[1] < 2**52:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, rounded up: never below the true ones."""
    a, b = _norms(x)[:, None], _norms(pivots)
    squares = a * a + b * b - 2 * (x.astype(float) @ pivots.astype(float).T)
    return np.sqrt(np.maximum(squares, 0)) + 1e-6 * (a + b + 1)


def merged_cells(pivots: np.ndarray, sizes: dict[int, int], most: int) -> dict[int, int]:
    """The group of each cell that has queries: neighbours in turn, ``most`` queries a group unless one cell has more."""
    left, order = set(sizes), []
    while left:
        near = _distance(pivots[order[-1:] or [min(left)]], pivots)[0]
        order.append(min(left, key=lambda c: (near[c], c)))
        left.remove(order[-1])
    groups: dict[int, int] = {}
    held, group = 0, 0
    for cell in order:
        if held and held + sizes[cell] > most:
            held, group = 0, group + 1
        groups[cell] = group
        held += sizes[cell]
    return groups


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """The ``k`` highest scores of each query (a row with a vec_id divisible by ``query_step``) against every other row.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id,
    and a query with fewer candidates returns them all. Each row that repeats a vec_id
    is a candidate, also for its like, and a query if its vec_id makes it one. See
    :func:`as_integers` for nulls. Scores beyond a long become the nearest long.
    Vectors of different length are filled up with zeros. An empty table gives no
    rows; only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    data = kept(as_integers(vectors))
    dim = max(data.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toPandas()
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(sample):
        return spark.createDataFrame([], schema)
    known, known_rows = _matrix(sample["v"], dim), sample["row"].to_numpy()
    pivots = known[:PIVOTS]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell of each vector and its distance to the cell's pivot."""
        for batch in batches:
            if len(batch):
                far = _distance(_matrix(batch["v"], dim), pivots)
                cell = far.argmin(1)
                yield batch.assign(cell=cell.astype(np.int32), far=far[np.arange(len(far)), cell])

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per group of queries and cell: how far from the pivot a vector must be to matter to one of the batch."""
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch["v"], dim)
            scores = np.where(batch["row"].to_numpy()[:, None] == known_rows, LEAST, inner(q, known))
            enough = scores.shape[1] > k
            least = np.partition(scores, -k, axis=1)[:, -k].astype(float) if enough else np.full(len(q), -np.inf)
            least[least <= LEAST] = -np.inf
            length = np.maximum(_norms(q), 1e-9)
            rounding = 1e-9 * (np.abs(np.where(np.isinf(least), 0, least)) / length)[:, None] + 1e-9 * _norms(pivots)
            need = (least[:, None] - q.astype(float) @ pivots.astype(float).T) / length[:, None] - rounding
            for g in np.unique(batch["cell"]):
                yield pd.DataFrame({"home": g, "cell": np.arange(len(pivots), dtype=np.int32), "need": need[batch["cell"] == g].min(0)})

    placed = kept(data.mapInPandas(place, f"{VEC}, cell int, far double"))
    queries = placed.where(F.col("vec_id") % query_step == 0)
    need = queries.mapInPandas(reach, "home int, cell int, need double").groupBy("home", "cell").agg(F.min("need").alias("need")).toPandas()
    counts = dict(placed.groupBy("cell").count().collect())
    sizes = dict(queries.groupBy("cell").count().collect())
    merged = merged_cells(pivots, sizes, QUERY_BLOCK)
    need["home"] = need["home"].map(merged)
    need = need.groupby(["home", "cell"], as_index=False)["need"].min()
    need["rows"] = need["cell"].map(counts).fillna(0)
    parts = {h: max(1, -(-int(n) // DATA_BLOCK)) for h, n in need.groupby("home")["rows"].sum().items()}
    asking: dict[int, int] = {}
    for cell, n in sizes.items():
        asking[merged[cell]] = asking.get(merged[cell], 0) + n
    groups = {h: max(1, -(-n // QUERY_BLOCK)) for h, n in asking.items()}
    # PIVOTS * PIVOTS rows at most
    table = [(int(r.cell), int(r.home), float(r.need) - 1e-6, parts[r.home], groups[r.home]) for r in need.itertuples()]
    needs = spark.createDataFrame(table, "cell int, home int, need double, parts int, groups int")

    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    salt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    copies = placed.join(F.broadcast(needs), "cell").where(F.col("far") >= F.col("need"))
    copies = copies.select(
        F.col("home").alias("to"), salt.alias("to_part"), numbers(F.col("groups")).alias("to_block"), "row", "vec_id", "v"
    )
    # A row for each cell that has queries, PIVOTS at most
    homes = spark.createDataFrame([(c, h, parts[h], groups[h]) for c, h in merged.items()], "cell int, home int, parts int, groups int")
    own = F.pmod(F.xxhash64("row"), F.col("groups")).cast("int")
    asked = queries.join(F.broadcast(homes), "cell")
    asked = asked.select(
        F.col("home").alias("home"), numbers(F.col("parts")).alias("part"), own.alias("block"), F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")
    )

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids, numbers, known = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), _matrix(rows["v"], dim)
        out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        for start in range(0, len(queries), STEP):
            step = queries.iloc[start : start + STEP]
            scores = inner(_matrix(step["q"], dim), known)
            for i, (query, query_id) in enumerate(zip(step["query"], step["query_id"], strict=True)):
                others = np.flatnonzero(numbers != query)
                best = others[np.argsort(~scores[i, others], kind="stable")[:k]]  # ~s falls as s grows and cannot overflow
                out.append(pd.DataFrame({"query": query, "query_id": query_id, "vec_id": ids[best], "score": scores[i, best]}))
        return pd.concat(out)

    found = asked.groupBy("home", "part", "block").cogroup(copies.groupBy("to", "to_part", "to_block"))
    found = found.applyInPandas(solve, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
