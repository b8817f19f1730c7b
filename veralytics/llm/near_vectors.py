"""Near duplicates among vectors of one label by PCA-ordered tiled comparison.

Vectors are turned to the axes of a principal component analysis, largest first,
and scaled to length one. A label's vectors are ordered by the leading component
and cut into tiles of bounded bytes; two tiles meet only where the span of their
angles to the leading axis allows the threshold. Inside a pair of tiles products
are added up over the leading components first. What the remaining components can
add is bounded by the product of the suffix norms (Cauchy-Schwarz), and a pair
whose bound stays below the threshold is given up; after the first few components
hardly any pair of unlike vectors is left.

Equal vectors of a label are one node with a weight, so copies are never compared
with each other. A pair of tiles returns counts of links per node and only as many
links as span its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from veralytics.llm.common import kept
from veralytics.llm.components import components

PERCENT = 93
# Vectors that the axes are fitted on at most; the axes change the speed, never the result.
SAMPLE = 4096
# Bytes of a tile's components; two tiles and a strip of their products are held by a task.
TILE_BYTES, STRIP = 2_000_000, 256
# Steps of the leading angle by which a label's vectors are ordered.
STEPS = 4096
# Components of the first and of each later step.
FIRST_DIMS, MORE_DIMS = 8, 16
# With a larger share of pairs left, whole rows and columns go on, else single pairs.
DENSE_SHARE, PAIRS = 0.02, 200_000
# Above the rounding of sums of products of unit vectors; pairs this near the threshold are computed in their own components.
SLACK = 1e-9


def whole(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part: label and vec_id given, no null or non-finite component, some component not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, fine) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False)))


def units(vectors: list, dim: int) -> np.ndarray:
    """Unit vectors as rows; a shorter one counts as filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if len(out):
        out /= np.abs(out).max(1, keepdims=True)  # neither very large nor very small components over- or underflow
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, those with the largest components first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Length of each row from each component on; the column behind the last is zero."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def _steps(dim: int) -> list[tuple[int, int]]:
    ends = [0, *range(FIRST_DIMS, dim, MORE_DIMS), dim]
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def hits(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (turned to the axes) whose product is ``least`` or more; ``own`` are their own components."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    rest_a, rest_b = suffix_norms(a), suffix_norms(b)
    sums, steps = np.zeros((len(a), len(b))), _steps(a.shape[1])
    i = j = np.zeros(0, np.int64)
    value = np.zeros(0)
    for done, (start, end) in enumerate(steps):
        sums += a[rows, start:end] @ b[cols, start:end].T
        alive = sums + rest_a[rows, end][:, None] * rest_b[cols, end] >= least - SLACK
        some_rows, some_cols = alive.any(1), alive.any(0)
        rows, cols, alive = rows[some_rows], cols[some_cols], alive[some_rows][:, some_cols]
        sums = sums[some_rows][:, some_cols]
        if end == a.shape[1] or not alive.size or alive.mean() < DENSE_SHARE:
            i, j = np.nonzero(alive)
            value, i, j = sums[i, j], rows[i], cols[j]
            steps = steps[done + 1 :]
            break
    found = []
    for start in range(0, len(i), PAIRS):
        x, y, v = i[start : start + PAIRS], j[start : start + PAIRS], value[start : start + PAIRS]
        for low, high in steps:
            v = v + np.einsum("ij,ij->i", a[x, low:high], b[y, low:high])
            near = v + rest_a[x, high] * rest_b[y, high] >= least - SLACK
            x, y, v = x[near], y[near], v[near]
        close = np.flatnonzero(np.abs(v - least) <= SLACK)
        v[close] = np.einsum("ij,ij->i", own_a[x[close]], own_b[y[close]])
        near = v >= least
        found.append((x[near], y[near]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def compare(
    one: np.ndarray, two: np.ndarray | None, weight_one: np.ndarray, weight_two: np.ndarray | None, turn: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links per row of ``one`` and ``two`` (unit vectors; None: ``one`` with itself), by weight, and each row's group."""
    alone = two is None
    both = one if alone else np.concatenate([one, two])
    weight = weight_one if alone else np.concatenate([weight_one, weight_two])
    turned = both @ turn
    n, first = len(one), 0 if alone else len(one)
    links, group = np.zeros(len(both), np.int64), np.arange(len(both))
    for start in range(0, n, STRIP):
        end = min(start + STRIP, n)
        low = start if alone else first
        x, y = hits(turned[start:end], turned[low:], both[start:end], both[low:], percent / 100)
        x, y = x + start, y + low
        if alone:
            x, y = x[x < y], y[x < y]
        links += np.bincount(x, weight[y], len(both)).astype(np.int64) + np.bincount(y, weight[x], len(both)).astype(np.int64)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(np.diff(x, prepend=-1))
        for a, b in zip(cuts, np.append(cuts, len(x))[1:], strict=True):
            own = np.append(group[y[a:b]], group[x[a]])
            least = own.min()
            if own.max() != least:
                group[np.isin(group, own)] = least
    return links, group


def near(vectors: DataFrame, percent: int = PERCENT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null and the cosine of
    their vectors, in double precision, is at least ``percent`` %. n_links counts the
    other rows linked with a row, component_id is the smallest vec_id reachable by
    links, itself included, kept is true for that one.

    Rows whose vector is null, empty, zero or holds a null or non-finite component,
    and rows without a label, link with nothing. Vectors of differing length are
    filled up with zeros. Rows that repeat a vec_id are rows of their own; rows with
    a null vec_id link with nothing, have no component and are not kept. Only the
    three columns are read, so other names cannot clash. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    alike = whole(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    # Written once, so the numbers stay as they are whatever becomes of the executors.
    nodes = kept(alike.withColumn("node", F.monotonically_increasing_id()))
    dim = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    sample = nodes.orderBy(F.xxhash64("node", "label"), "node").limit(SAMPLE).select("embedding").toPandas()
    turn = axes(units(sample["embedding"].tolist(), dim))
    lead, tile_rows = turn[:, 0].copy(), max(64, TILE_BYTES // (8 * dim))

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angle = np.arccos(np.clip(units(batch["embedding"].tolist(), dim) @ lead, -1, 1))
                yield batch.assign(angle=angle, step=np.minimum(angle / np.pi * STEPS, STEPS - 1).astype(np.int32))

    placed = kept(nodes.mapInPandas(angles, StructType([*nodes.schema.fields]).add("angle", DoubleType()).add("step", IntegerType())))
    # Whole steps are put into tiles in order; a step of more vectors than a tile holds is dealt to tiles of its own.
    sizes = placed.groupBy("label", "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    tiles = sizes.select(
        "label", "step", F.floor(F.coalesce(upto, F.lit(0)) / tile_rows).cast("int").alias("base"),
        F.ceil(F.col("n") / tile_rows).cast("int").alias("shares"),
    )
    share = F.when(F.col("shares") > 1, F.pmod(F.xxhash64("node"), "shares").cast("int")).otherwise(0)
    tiled = placed.join(tiles, ["label", "step"]).withColumn("share", share).withColumn("tile", F.struct("base", "share"))
    tiled = kept(tiled.select("label", "tile", "node", "weight", "angle", "embedding"))
    # One row per tile. Tiles that may hold linked vectors lie no more than the threshold's angle apart.
    reach = float(np.arccos(percent / 100)) + 1e-6
    spans = kept(tiled.groupBy("label", "tile").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    cells = F.sequence(cell("low") - 1, cell("high") + 1)
    left = spans.select("label", F.col("tile").alias("one"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(cells).alias("cell"))
    right = spans.select("label", F.col("tile").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"), cell("low").alias("cell"))
    meets = (F.col("low2") <= F.col("high1") + reach) & (F.col("low1") <= F.col("high2") + reach)
    pairs = left.join(right, ["label", "cell"]).where(meets).select("label", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
    pairs = kept(pairs.withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("label", "pair", F.col("one").alias("tile"), F.lit(0).alias("side")).union(
        pairs.where("one <> two").select("label", "pair", "two", F.lit(1))
    )
    copies = tiled.join(sides, ["label", "tile"]).select("pair", "side", "node", "weight", "embedding")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "node"], ignore_index=True)
        n, node, weight = int((part["side"] == 0).sum()), part["node"].to_numpy(), part["weight"].to_numpy()
        x = units(part["embedding"].tolist(), dim)
        two = (x[n:], weight[n:]) if n < len(x) else (None, None)
        links, group = compare(x[:n], two[0], weight[:n], two[1], turn, percent)
        some = links > 0
        least = pd.Series(node).groupby(group).transform("min").to_numpy()
        return pd.DataFrame({"node": node[some], "links": links[some], "least": least[some]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = kept(copies.repartition(parts, "pair").groupBy("pair").applyInPandas(solve, "node long, links long, least long"))
    joined = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "label", "embedding", "first", "weight").join(counted, "node", "left").join(joined, "node", "left")
    known = kept(known.withColumn("component", F.coalesce("component", "node")))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select(
        F.col("label").alias("known_label"), F.col("embedding").alias("known"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    mine = rows.withColumn("takes_part", F.col("vec_id").isNotNull())
    out = mine.join(known, F.col("takes_part") & (F.col("label") == F.col("known_label")) & (F.col("embedding") == F.col("known")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM w),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.r <> b.r
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= {PERCENT / 100}),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
c AS (
  WITH RECURSIVE reached(vec_id, other) AS (SELECT a, b FROM l UNION SELECT r.vec_id, l.b FROM reached r JOIN l ON l.a = r.other)
  SELECT vec_id, min(other) AS least FROM reached GROUP BY vec_id)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""
