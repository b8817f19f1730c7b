"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's hash places it in a block of its source. Each source owes the mix
an exact number of draws of its blocks (all blocks once per full pass, then the
first blocks of a permutation, the last one up to a cut). A tree halves the
output shards again and again; at every node one multivariate-hypergeometric
draw splits the sources' quotas between the halves, so every shard has its exact
quota and a random composition. Shards then take disjoint runs of each source's
permuted draws and order their documents by a keyed hash.

The driver holds one summary row per source and per block: ``MAX_SOURCES`` and
``MAX_SHARDS * BLOCKS_PER_SHARD`` at most, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import kept, packed

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SHARD_WORDS = 2_000_000
LEAST_SHARDS, MAX_SHARDS, BLOCKS_PER_SHARD = 16, 16_384, 16
MAX_SOURCES = 100_000
# The last block of a source is cut at one of so many parts.
PARTS = 65_536
WORD = r"[^\x20\x09-\x0D]+"
DRAWS = "source_no int, block int, draws array<struct<pass_no: int, shard: int, cut: int>>"


def size_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess shared anew by weight."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        for i in sorted(over or open_):
            out[i] = float(most * sizes[i]) if over else left * weights[i] / total
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas per shard and source: halve the shards, and draw without replacement what goes left."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    taken = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split_quotas(taken, left, rng), split_quotas(quotas - taken, shards - left, rng)])


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and ``at``: a place in the source, uniform in [0, 2**31) and the same in every run."""
    key = docs["doc_id"].cast("long")
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 33)
    return docs.select(key.alias("doc_id"), docs["source"], size_of(docs["text"]).alias("size"), at.alias("at"))


def _placed(sized: DataFrame, sources: pd.DataFrame) -> DataFrame:
    """``sized`` with source_no, target, source_size, block and part of the block."""
    spark = sized.sparkSession
    known = spark.createDataFrame(
        [tuple(r) for r in sources[["source", "source_no", "source_size", "target", "blocks"]].astype(object).to_numpy()],
        "known string, source_no int, source_size long, target double, blocks int",
    )
    spread = F.col("at") * F.col("blocks")
    return (
        sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["known"]))
        .withColumn("block", F.shiftright(spread, 31).cast("int"))
        .withColumn("part", F.shiftright(spread.bitwiseAND(F.lit(2**31 - 1)), 15).cast("int"))
        .drop("known", "blocks", "at")
    )


def _draw_lists(sources: pd.DataFrame, blocks: pd.DataFrame, seed: int) -> tuple[list[list[list[int]]], dict]:
    """Per source its draws [block, pass, cut] in permuted order, and for the last block how many words it still owes."""
    lists, owed = [], {}
    by_source = dict(list(blocks.groupby("source_no")))
    for no, size, target in sources[["source_no", "source_size", "target"]].itertuples(index=False):
        rng, own, draws = np.random.default_rng([seed, no]), by_source[no], []
        passes = int(target / size + 1e-9) if size else 0
        for p in range(passes):
            draws += [[int(b), p, PARTS] for b in rng.permutation(own["block"].to_numpy())]
        rest = target - passes * size
        if size and rest > 0.5:
            order = own.iloc[rng.permutation(len(own))]
            for b, words in order[["block", "words"]].itertuples(index=False):
                draws.append([int(b), passes, PARTS])
                if words > rest:
                    owed[no] = (int(b), float(rest))
                    break
                rest -= words
        lists.append(draws)
    return lists, owed


def _cuts(placed: DataFrame, owed: dict) -> dict[int, int]:
    """For each source the number of parts of its last block whose words come nearest to what is owed."""
    if not owed:
        return {}
    last = placed.sparkSession.createDataFrame([(n, b, r) for n, (b, r) in owed.items()], "source_no int, block int, rest double")
    parts = placed.join(F.broadcast(last), ["source_no", "block"]).groupBy("source_no", "part").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest")
    )  # at most PARTS rows per source
    upto = F.expr("sum(words) OVER (PARTITION BY source_no ORDER BY part)")
    near = parts.withColumn("off", F.abs(upto - F.col("rest"))).groupBy("source_no").agg(
        F.min(F.struct("off", F.col("part") + 1)).alias("best")
    )
    return {r["source_no"]: r["best"][1] if r["best"][0] < owed[r["source_no"]][1] else 0 for r in near.collect()}


def drawn(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Columns: doc_id, source, size (words of the text), source_size, target (its
    source's words in the mix), draws (pass_no and shard of each time that it is
    taken), taken (size times the number of draws).

    Sources in order of code points, null last, weigh ``weights`` in turn and share
    the total size; a target stops at three times its source's size. Reruns agree.
    Null and empty texts have size 0 and are drawn at no cost. Repeated rows, and
    rows with a null doc_id, share one place and are drawn together. An empty table
    gives no rows. Only doc_id, source and text are read.
    """
    spark = docs.sparkSession
    sized = kept(_sized(docs, seed))
    rows = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in rows]
    total = max(sum(sizes), 1)
    shards = min(MAX_SHARDS, max(LEAST_SHARDS, -(-total // SHARD_WORDS)))
    blocks = shards * BLOCKS_PER_SHARD
    sources = pd.DataFrame(
        {
            "source": [r["source"] for r in rows], "source_no": range(len(rows)), "source_size": sizes,
            "target": targets(sizes, [weights[i % len(weights)] for i in range(len(rows))]),
            "blocks": [max(1, -(-blocks * s // total)) for s in sizes],
        }
    )
    placed = _placed(sized, sources)
    per_block = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words")).orderBy("source_no", "block").toPandas()
    lists, owed = _draw_lists(sources, per_block, seed)
    cuts = _cuts(placed, owed)
    for no, (block, _) in owed.items():
        lists[no][-1][2] = cuts.get(no, 0)

    quotas = split_quotas(np.array([len(x) for x in lists], np.int64), shards, np.random.default_rng([seed, 2**31])) if lists else []
    plan: dict[tuple[int, int], list] = {}
    for no, own in enumerate(lists):
        for (block, pass_no, cut), shard in zip(own, np.repeat(np.arange(shards), quotas[:, no]), strict=True):
            plan.setdefault((no, block), []).append((pass_no, int(shard), cut))
    plan_table = spark.createDataFrame([(n, b, d) for (n, b), d in plan.items()], DRAWS)  # about three rows' worth per block
    out = placed.join(F.broadcast(plan_table), ["source_no", "block"], "left")
    mine = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass_no: int, shard: int, cut: int>>")), lambda d: d["cut"] > F.col("part"))
    return out.withColumn("draws", mine).select(
        "doc_id", "source", "size", "source_size", "target", "draws", (F.col("size") * F.size("draws")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, by shard and shuffled inside shards.

    All columns stay as they are. Rows whose doc_id is null are told apart by
    nothing but their source, so they are drawn together.
    """
    plan = drawn(docs, weights, seed).where(F.size("draws") > 0).groupBy("doc_id", "source").agg(F.first("draws").alias("draws"))
    plan = plan.select("doc_id", "source", F.explode("draws").alias("draw"))
    rows = docs.select(packed(docs).alias("row"))  # one column, so that no name of docs can clash
    rows = rows.join(plan, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")))
    order = F.xxhash64(F.lit(seed), F.col("draw.shard"), F.col("draw.pass_no"), F.col("doc_id"))
    shards = F.col("draw.shard")
    return rows.repartition(shards).sortWithinPartitions(shards, order).select(*[F.col("row")[c].alias(c) for c in docs.columns])
