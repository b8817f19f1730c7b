"""URL filters: allow and block rules, and a character language-model ratio for the rest.

Two variable-order Markov models over characters, one of accepted and one of
rejected URLs (those that a rule judges), are smoothed from order to order. A
URL that no rule fits is judged by the length-normalised difference of its two
log-likelihoods against a threshold calibrated on URLs kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics.llm.common import kept

# (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
ORDER = 5
# Scores are counted in steps of 1 / STEPS to find the threshold.
STEPS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIX = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, and rule and verdict of the longest rule that fits (null without one)."""
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    dotted = F.concat(F.lit("."), F.col("host"))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule wraps the shorter
        fits = F.endswith(dotted, F.lit("." + host)) & F.startswith(F.col("path"), F.lit(path))
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return out.withColumn("_found", found).select("page_id", "url", "host", "path", "_found.rule", "_found.verdict")


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the contexts of length 0 to ORDER before each character, keys with the character, and the URL's number.

    A URL ends with a character of its own, which is predicted too; contexts stop at its start.
    """
    points = [np.frombuffer((u + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32) for u in urls]
    lengths = np.array([len(p) for p in points], np.int64)
    char = np.concatenate(points).astype(np.uint64) if points else np.zeros(0, np.uint64)
    place = np.arange(len(char)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = np.zeros((ORDER + 1, len(char)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            back = np.where(place >= k, np.roll(char, k), np.uint64(2))  # 2 stands before the start
            context[k] = (context[k - 1] ^ (back + np.uint64(k << 32))) * MIX
            context[k] ^= context[k] >> np.uint64(29)
        joint = (context ^ (char + np.uint64(1 << 40))) * MIX
        joint ^= joint >> np.uint64(31)
    return context, joint, np.repeat(np.arange(len(urls)), lengths)


@dataclass
class Markov:
    """Counts by order: sorted keys with the times that a context (or a context with its next character) was seen."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    joints: list[tuple[np.ndarray, np.ndarray]]
    alphabet: int

    @classmethod
    def of(cls, urls: list[str]) -> Markov:
        context, joint, _ = _grams(urls)
        contexts, joints = [], []
        for k in range(ORDER + 1):
            keys, at, seen = np.unique(context[k], return_inverse=True, return_counts=True)
            pairs, first, times = np.unique(joint[k], return_index=True, return_counts=True)
            contexts.append((keys, seen, np.bincount(at[first], minlength=len(keys))))
            joints.append((pairs, times))
        return cls(contexts, joints, 256)

    def log_likelihood(self, context: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Per character; each order takes what its context leaves open from the order below (Witten-Bell)."""
        p = np.full(joint.shape[1], 1 / self.alphabet)
        for k in range(ORDER + 1):
            keys, seen, kinds = self.contexts[k]
            pairs, times = self.joints[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, context[k]), len(keys) - 1)
            hit = keys[at] == context[k]
            n, t = np.where(hit, seen[at], 0), np.where(hit, kinds[at], 1)
            at = np.minimum(np.searchsorted(pairs, joint[k]), len(pairs) - 1)
            c = np.where(pairs[at] == joint[k], times[at], 0)
            p = (c + t * p) / (n + t)
        return np.log(p)


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    least: float = 0.0

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Mean difference of log-likelihood per character; positive: closer to accepted URLs."""
        context, joint, of = _grams([u or "" for u in urls])
        gap = self.accepted.log_likelihood(context, joint) - self.rejected.log_likelihood(context, joint)
        return np.bincount(of, gap, len(urls)) / np.maximum(np.bincount(of, minlength=len(urls)), 1)


def best_cut(values: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between ascending values, seen so often on each side, with the least mean error; 0 if one side is missing."""
    if not good.sum() or not bad.sum():
        return 0.0
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    below = lambda n: np.concatenate([[0], np.cumsum(n)]) / n.sum()
    error = below(good) + 1 - below(bad)
    best = np.flatnonzero(error == error.min())
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score that separates the two sides with the least mean error; 0 if one side is missing."""
    values, at = np.unique(np.concatenate([good, bad]), return_inverse=True)
    return best_cut(values, np.bincount(at[: len(good)], minlength=len(values)), np.bincount(at[len(good) :], minlength=len(values)))


def gram_counts(urls: DataFrame) -> DataFrame:
    """How often each gram of order k (a character after its k before it) occurs in the URLs of either side.

    ``urls`` (url, side: allow, block or null). ``context`` and ``below`` are the keys of the
    gram's context and of its gram one order lower. Grams of URLs without a side count 0.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            context, joint, of = _grams(batch["url"].tolist())
            sides = {v: (batch["side"] == v).to_numpy(dtype=float)[of] for v in ("allow", "block")}
            for k in range(ORDER + 1):
                keys, first, at = np.unique(joint[k], return_index=True, return_inverse=True)
                times = {v: np.bincount(at, w, len(keys)).astype(np.int64) for v, w in sides.items()}
                below = joint[max(k - 1, 0)][first].view(np.int64)
                yield pd.DataFrame({"k": k, "joint": keys.view(np.int64), "context": context[k][first].view(np.int64), "below": below} | times)

    rows = urls.select("url", "side").mapInPandas(count, "k int, joint long, context long, below long, allow long, block long")
    return rows.groupBy("k", "joint", "context", "below").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def gram_gaps(counts: DataFrame) -> DataFrame:
    """Difference of the two models' log-likelihoods for each gram of the highest order, as in :class:`Markov`.

    Each order takes what its context leaves open from the order below. A context has at
    most as many rows as there are characters, and so has a gram of the order below.
    """
    same = W.partitionBy("k", "context")
    stats = kept(counts.select("*", *[f(F.col(v)).over(same).alias(f"{v}_{n}") for v in ("allow", "block") for n, f in (("seen", F.sum), ("kinds", lambda c: F.count_if(c > 0)))]))
    level = None
    for k in range(ORDER + 1):
        own = stats.where(F.col("k") == k)
        own = own.select("*", *[F.lit(1 / 256).alias(f"p_{v}") for v in ("allow", "block")]) if level is None else own.join(level, "below")
        p = {}
        for v in ("allow", "block"):
            kinds = F.greatest(F.col(f"{v}_kinds"), F.lit(1))
            p[v] = (F.col(v) + kinds * F.col(f"p_{v}")) / (F.col(f"{v}_seen") + kinds)
        level = own.select(F.col("joint").alias("below"), *[x.alias(f"p_{v}") for v, x in p.items()])
    return level.select(F.col("below").alias("joint"), (F.log("p_allow") - F.log("p_block")).alias("gap"))


def url_scores(urls: DataFrame, gaps: DataFrame) -> DataFrame:
    """id and score: the mean gap over the characters of each URL and its end. ``urls`` (id, url)."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, joint, of = _grams(batch["url"].tolist())
            yield pd.DataFrame({"id": batch["id"].to_numpy()[of], "joint": joint[ORDER].view(np.int64)})

    return urls.select("id", "url").mapInPandas(grams, "id long, joint long").join(gaps, "joint").groupBy("id").agg(F.avg("gap").alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The best cut over all rows (score, verdict), on a grid of 1 / STEPS; only counts per step come to the driver."""
    counts = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")]
    )
    steps = np.array(sorted(tuple(r) for r in counts.collect()), np.int64).reshape(-1, 3)
    return best_cut((steps[:, 0] + 0.5) / STEPS, steps[:, 1], steps[:, 2])


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict (allow or block), one row per row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest fitting rule decides. Otherwise the URL is allowed if its score reaches
    the calibrated threshold. The models count all distinct URLs that a rule judges but
    those whose hash is divisible by 5; all of these calibrate. A null URL is scored as an
    empty one. Without judged URLs of both kinds the threshold is 0. Repeated rows are
    judged alike; columns other than page_id and url are not read; an empty table gives no
    rows. Counts and scores stay tables: neither the driver nor a task holds a model.
    """
    judged = ruled(pages, rules)
    whole = F.coalesce("url", F.lit(""))
    known = judged.select(F.xxhash64(whole).alias("id"), whole.alias("url"), F.when(F.col("url").isNotNull(), F.col("verdict")).alias("verdict"))
    urls = kept(known.groupBy("id").agg(F.min("url").alias("url"), F.min("verdict").alias("verdict")))
    held_out = F.pmod("id", F.lit(5)) == 0
    gaps = gram_gaps(gram_counts(urls.withColumn("side", F.when(~held_out, F.col("verdict")))))
    scores = kept(url_scores(urls, gaps))
    least = calibrated(urls.where(held_out & F.col("verdict").isNotNull()).join(scores, "id"))
    own = F.when(F.col("score") >= least, "allow").otherwise("block")
    return judged.withColumn("id", F.xxhash64(whole)).join(scores, "id").select(
        "page_id", "host", "path", "rule", "score", F.coalesce("verdict", own).alias("verdict")
    )
