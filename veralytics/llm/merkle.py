"""Merkle manifest of a dataset with proofs by octopus multiproofs.

Every document is a leaf; leaves of one language form a tree, the languages' roots
form the tree above. Places in a tree come from one range-partitioned sort and the
sizes of its partitions, so no language is numbered in one task.

A tree is built from runs of ``2**BITS`` leaves: one task turns a run into all its
nodes, the runs' tops are the leaves of the next round, and so on until one node is
left. A leaf partition is such a run. For all its proofs together it needs only
the nodes that its own leaves do not give (the octopus's arms: going up from a run,
one neighbour a level at most). Their coordinates are joined with the stored nodes
once; the run then derives the interiors that its leaves share, and expands the
proof of each leaf without further data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veralytics.llm.common import CRC32_SQL, kept

# Leaves of a run, as a power of two.
BITS = 10
TAMPER = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with idx (from 0, by ``order``, nulls first) and n (rows) within each ``group``.

    Sorted by ranges and written once; only the number of rows of each group in each
    partition is summed up. A large group spans as many partitions as it needs.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    within = Window.partitionBy(group)
    before = F.sum("rows").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(
        F.col(group).alias("of"), "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(within).alias("n")
    )
    out = ranged.withColumn("own_part", part).join(sizes, F.col(group).eqNullSafe(F.col("of")) & (F.col("own_part") == F.col("part")))
    return out.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "own_part", "of", "part", "shift")


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def grow(nodes: Sequence[str], levels: int) -> list[list[str]]:
    """The levels above consecutive nodes, the first of which has an even place at every level but the last."""
    out = [list(nodes)]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


class Forest:
    """Trees over the rows of ``leaves``: node, idx and n within each ``group``."""

    def __init__(self, leaves: DataFrame, group: str, bits: int | None = None) -> None:
        self.group, self.bits = group, BITS if bits is None else bits
        self.kind = leaves.schema[group].dataType.simpleString()
        self.tops = self._round(leaves.select(group, "node", "idx", F.col("n").cast("long").alias("left")), 0)
        self.nodes = [self.tops]
        level = self.bits
        while not (open_ := self.tops.where("left > 1")).isEmpty():  # left: nodes of the tree on this level
            above = self._round(open_.select(group, "node", "idx", "left"), level)
            self.nodes.append(above.where(F.col("level") > level))
            top = F.least(F.col("height"), F.lit(level + self.bits))
            self.tops = above.where(F.col("level") == top).union(self.tops.where("left = 1"))
            level += self.bits

    def _round(self, below: DataFrame, level: int) -> DataFrame:
        """The nodes of each run: at the lowest round only its top, later all."""
        group, bits = self.group, self.bits

        def build(key, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("idx", ignore_index=True)
            left, first = int(part["left"].iloc[0]), int(part["idx"].iloc[0])
            levels = grow(part["node"].tolist(), min(bits, height(left)))
            rows = [
                (level + k, (first >> k) + i, node, -(-left // 2**k), level + height(left))
                for k, nodes in enumerate(levels) for i, node in enumerate(nodes)
            ]
            out = pd.DataFrame(rows if level else rows[-1:], columns=["level", "idx", "node", "left", "height"])
            out[group] = pd.Series([key[0]] * len(out), dtype=part[group].dtype)
            return out[[group, "level", "idx", "node", "left", "height"]]

        runs = below.withColumn("run", F.shiftright("idx", bits)).groupBy(group, "run")
        return kept(runs.applyInPandas(build, f"{group} {self.kind}, level int, idx long, node string, left long, height int"))

    def roots(self) -> DataFrame:
        return self.tops.select(self.group, F.col("node").alias("root"))

    def arms(self, runs: DataFrame) -> DataFrame:
        """(group, run, level, node): what each run lacks for its proofs, the union of its leaves' missing siblings."""
        group, bits = self.group, self.bits
        levels = F.sequence(F.lit(bits), F.col("height") - 1)
        lacks = runs.where(F.col("height") > bits).select(group, "run", F.explode(levels).alias("level"))
        lacks = lacks.withColumn("idx", F.expr(f"(run >> (level - {bits})) ^ 1"))
        stored = self.nodes[0]
        for more in self.nodes[1:]:
            stored = stored.union(more)
        stored = stored.where(F.col("level") >= bits).select(F.col(group).alias("of"), F.col("level").alias("at"), F.col("idx").alias("place"), "node")
        found = lacks.join(stored, F.col(group).eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")) & (F.col("idx") == F.col("place")))
        return found.select(F.col(group).alias("arm_group"), F.col("run").alias("arm_run"), F.col("level").alias("arm_level"), F.col("node").alias("arm_node"))

    def proofs(self, leaves: DataFrame, expand, schema: str) -> DataFrame:
        """``expand`` of each run's leaves and paths; a path is a list of (sibling, whether it stands left) from below."""
        group, bits = self.group, self.bits
        placed = leaves.withColumn("run", F.shiftright("idx", bits))
        tall = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
        arms = self.arms(placed.select(group, "run", tall.alias("height")).distinct())

        def solve(part: pd.DataFrame, arms: pd.DataFrame) -> pd.DataFrame:
            if not len(part):
                return expand(part, [])
            part = part.sort_values("idx", ignore_index=True)
            n, first = int(part["n"].iloc[0]), int(part["idx"].iloc[0])
            own = grow(part["node"].tolist(), min(bits, height(n)))
            above = dict(zip(arms["arm_level"], arms["arm_node"], strict=True))
            run, tail = first >> bits, []
            for level in range(bits, height(n)):  # shared by all leaves of the run
                if level in above:
                    tail.append((above[level], bool(run >> (level - bits) & 1)))
            paths = []
            for i in range(len(part)):
                path = []
                for level in range(min(bits, height(n))):
                    other = i >> level ^ 1
                    if other < len(own[level]):
                        path.append((own[level][other], bool(i >> level & 1)))
                paths.append(path + tail)
            return expand(part, paths)

        return placed.groupBy(group, "run").cogroup(arms.groupBy("arm_group", "arm_run")).applyInPandas(solve, schema)


def fold(node: str, path: list[tuple[str, bool]], n: int, idx: int) -> str:
    """The root that a leaf and its siblings give; a level without a sibling hashes the node alone."""
    rest = iter(path)
    for level in range(height(n)):
        count = -(-n // 2**level)
        place = idx >> level
        if place ^ 1 < count:
            other, left = next(rest)
            node = digest(other, node) if left else digest(node, other)
        else:
            node = digest(node)
    return node


def manifest(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """The Merkle manifest of ``docs``, a row per row with its proof, checked against a tampered copy.

    leaf, subroot (root of its language's tree), root, proof (the siblings from the
    leaf to the root, left to right on each level), proof_sha256, folded_root (from the
    tampered leaf where the document is tampered, else its own, and the untampered
    siblings), verified.

    Leaves hash doc_id, source, lang, n_chars and text. A null is ``-``, so an empty
    text differs from none. Leaves of a language, null first among languages and
    doc_ids, go by doc_id, repeated ones by leaf; equal rows are leaves of their own.
    Tampering adds 1 to n_chars, so a row without n_chars, or without a doc_id, stays
    as it is. Other columns are not read. An empty table gives no rows.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars"), F.col("text")
    )
    c = {name: F.col(name) for name in own.columns}
    tampered = F.coalesce(F.crc32(c["doc_id"].cast("string").cast("binary")) % TAMPER == 0, F.lit(False)) & c["n_chars"].isNotNull()
    rest = c["source"], c["lang"]
    leaves = own.select(
        "doc_id", "lang", leaf(c["doc_id"], *rest, c["n_chars"], c["text"]).alias("node"),
        F.when(tampered, leaf(c["doc_id"], *rest, c["n_chars"] + 1, c["text"])).alias("forged"),
    )
    leaves = kept(numbered(kept(leaves), "lang", "doc_id", "node"))  # texts are hashed once
    trees = Forest(leaves, "lang", bits)
    subroots = trees.roots().select(F.lit(0).alias("all"), "lang", F.col("root").alias("node"))
    subroots = kept(numbered(subroots, "all", "lang"))
    crown = Forest(subroots, "all", bits)

    def above(part: pd.DataFrame, paths: list) -> pd.DataFrame:
        """Each language's way from its root to the root of all."""
        rows = [
            (lang, node, fold(node, path, n, idx), [s for s, _ in path], n, idx)
            for lang, node, n, idx, path in zip(part["lang"], part["node"], part["n"], part["idx"], paths, strict=True)
        ]
        out = pd.DataFrame(rows, columns=["top_lang", "subroot", "root", "above", "langs", "lang_no"])
        return out.assign(top_lang=out["top_lang"].astype(object).where(out["top_lang"].notna(), None))

    ways = kept(crown.proofs(subroots, above, "top_lang string, subroot string, root string, above array<string>, langs long, lang_no long"))

    def expand(part: pd.DataFrame, paths: list) -> pd.DataFrame:
        rows = []
        for doc_id, node, forged, n, idx, path in zip(*(part[c] for c in ("doc_id", "node", "forged", "n", "idx")), paths, strict=True):
            told = node if forged is None else forged
            rows.append((doc_id, node, [s for s, _ in path], fold(told, path, n, idx)))
        out = pd.DataFrame(rows, columns=["doc_id", "leaf", "proof", "folded"])
        lang = part["lang"].iloc[0] if len(part) else None
        return out.assign(doc_id=out["doc_id"].astype("Int64"), lang=pd.Series([lang] * len(out), dtype=object))

    low = trees.proofs(leaves, expand, "doc_id long, lang string, leaf string, proof array<string>, folded string")
    both = low.join(ways, low["lang"].eqNullSafe(ways["top_lang"]))

    proof = F.concat("proof", "above")
    folded = F.col("folded")
    # From the language's root on, the fold goes through its place among the languages.
    step = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("langs") > 1, F.length(F.bin(F.col("langs") - 1))).otherwise(0) - 1)),
        F.struct(folded.alias("node"), F.lit(0).alias("used"), F.col("langs").alias("count"), F.col("lang_no").alias("place")),
        lambda a, level: F.when(a["count"] <= 1, a).otherwise(_up(a)),
        lambda a: a["node"],
    )
    return both.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(proof, "").cast("binary"), 256).alias("proof_sha256"),
        step.alias("folded_root"), (step == F.col("root")).alias("verified"), proof.alias("proof"),
    )


def _up(a: Column) -> Column:
    """One level up the tree of languages: the node, siblings used, nodes of the level and the place."""
    other = F.get("above", a["used"])
    paired = a["place"].bitwiseXOR(F.lit(1).cast("long")) < a["count"]
    joined = F.when(~paired, a["node"]).when(a["place"] % 2 == 1, F.concat(other, a["node"])).otherwise(F.concat(a["node"], other))
    return F.struct(
        F.sha2(joined.cast("binary"), 256).alias("node"), (a["used"] + paired.cast("int")).alias("used"),
        F.floor((a["count"] + 1) / 2).cast("long").alias("count"), F.shiftright(a["place"], 1).alias("place"),
    )


def _oracle() -> str:
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
    leaf = lambda n: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", n, "text")) + ")"

    def tree(name: str, key: str, leaves: str) -> str:
        return f"""{name}(level, {key}, idx, node, n) AS (
  SELECT 0, {key}, idx, node, n FROM {leaves} UNION ALL
  SELECT level + 1, {key}, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY level, {key}, idx // 2, n)"""

    def folds(name: str, key: str, start: str, nodes: str) -> str:
        return f"""{name}(r, level, {key}, node, idx, n) AS (
  {start} UNION ALL
  SELECT r, f.level + 1, f.{key}, sha256(CASE WHEN s.node IS NULL THEN f.node WHEN f.idx % 2 = 1 THEN s.node || f.node ELSE f.node || s.node END),
    f.idx // 2, (f.n + 1) // 2
  FROM {name} f LEFT JOIN {nodes} s ON s.{key} IS NOT DISTINCT FROM f.{key} AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1)"""

    return f"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k, row_number() OVER () AS r FROM documents),
c AS (SELECT *, n_chars + CASE WHEN k <> '' AND ({CRC32_SQL}) % {TAMPER} = 0 THEN 1 ELSE 0 END AS told_chars FROM k),
h AS (SELECT r, doc_id, lang, {leaf("n_chars")} AS node, {leaf("told_chars")} AS told FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
{tree("t", "lang", "o")},
tops AS (SELECT 0 AS g, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
{tree("u", "g", "tops")},
low AS (SELECT o.r, t.level, t.node FROM o JOIN t ON t.lang IS NOT DISTINCT FROM o.lang AND t.n > 1 AND t.idx = xor(o.idx >> t.level, 1)),
high AS (SELECT o.r, 1000 + u.level AS level, u.node FROM o JOIN tops p ON p.lang IS NOT DISTINCT FROM o.lang
  JOIN u ON u.n > 1 AND u.idx = xor(p.idx >> u.level, 1)),
proofs AS (SELECT r, string_agg(node, '' ORDER BY level) AS proof FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY r),
{folds("fl", "lang", "SELECT r, 0, lang, told, idx, n FROM o", "t")},
{folds("fh", "g", "SELECT fl.r, 0, 0, fl.node, p.idx, p.n FROM fl JOIN tops p ON p.lang IS NOT DISTINCT FROM fl.lang WHERE fl.n = 1", "u")}
SELECT o.doc_id, o.node AS leaf, tops.node AS subroot, root.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, fh.node AS folded_root,
  fh.node = root.node AS verified
FROM o JOIN tops ON tops.lang IS NOT DISTINCT FROM o.lang CROSS JOIN (SELECT node FROM u WHERE n = 1) root
  JOIN fh ON fh.r = o.r AND fh.n = 1 LEFT JOIN proofs ON proofs.r = o.r
"""


ORACLE = _oracle()
