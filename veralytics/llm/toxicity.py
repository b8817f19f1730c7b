"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. Both hold
the words that the two kinds share; each also holds the words that stand out in
its own kind. A text is cut into windows, and a window that compresses better
with the toxic dictionary speaks for toxicity. How much better, over the whole
text and in its worst window, is turned into a calibrated probability.

Short words save a compressor too few bytes to be seen, so texts are compressed
as streams of 16-byte word digests: a word that a dictionary knows is one match,
any other word is 16 bytes that cannot be compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import chunks
from veralytics.llm.labelled import HELD_OUT, held_out
from veralytics.llm.shingles import mixed

WINDOW = 32
# Labelled documents that a model is fitted on at most: toxic and ordinary, for the dictionaries and for the calibration.
TOXIC_ROWS, ORDINARY_ROWS = 4_000, 12_000
# Words of a dictionary at most: common to both kinds, and standing out in one.
COMMON, OWN = 1_000, 4_000
LEAST_DOCS, LEAST_RATIO = 4, 12.0
LEAST_SCORE = 0.3
MARKS = ".,;:!?\"'()[]{}<>|#*$%&@/\\-+=_~`^"
_BLANK = bytes.maketrans(MARKS.encode(), b" " * len(MARKS))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANK).split()


def digests(words: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each word."""
    h = pd.util.hash_array(np.array(words, dtype=object)) if words else np.zeros(0, np.uint64)
    return np.column_stack([h, mixed(h ^ np.uint64(0x5851F42D4C957F2D))])


class Compressor:
    """Lengths of windows compressed with one dictionary."""

    def __init__(self, content: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            5, min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        self.compress = zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress

    def lengths(self, windows: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self.compress(w)) for w in windows), np.int64, len(windows))


@dataclass
class Model:
    """The dictionaries' contents, and the calibration over the measures of :func:`measures`."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    start: float

    def gains(self, texts: list[str | None]) -> np.ndarray:
        """Per text: bytes saved a word, bytes saved in the worst window, windows that save over half a word, each damped."""
        toxic, ordinary = Compressor(self.toxic), Compressor(self.ordinary)
        out = []
        for part in chunks(texts):
            split = [_words(t) for t in texts[part]]
            n = np.array([len(w) for w in split], np.int64)
            stream = digests([w for ws in split for w in ws])
            windows, of, start = [], [], 0
            for i, size in enumerate(n):
                for a in range(start, start + size, WINDOW):
                    windows.append(stream[a : min(a + WINDOW, start + size)].tobytes())
                    of.append(i)
                start += size
            gain = (ordinary.lengths(windows) - toxic.lengths(windows)).astype(float)
            of = np.array(of, np.int64)
            worst = np.zeros(len(n))
            np.maximum.at(worst, of, gain)
            rate = np.maximum(np.bincount(of, np.maximum(gain, 0), len(n)) / np.maximum(n, 1), 0)
            many = np.bincount(of[gain >= 8], minlength=len(n))
            out.append(np.column_stack([np.sqrt(rate), rate, np.log1p(worst), np.log1p(many), many / np.maximum(np.ceil(n / WINDOW), 1)]))
        return np.concatenate(out) if out else np.zeros((0, 5))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.start + self.gains(texts) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's steps."""
    scale = np.maximum(x.std(0), 1e-6)
    full = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    hold = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        w += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + hold, full.T @ (y - p) - hold @ w)
    return w[:-1] / scale, float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> DataFrame:
    """text, y, and whether a row calibrates; of each kind the rows with the smallest hashes of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    order = [F.xxhash64("id"), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(toxic_rows).union(known.where("y = 0").orderBy(*order).limit(ordinary_rows))
    calibrates = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == (HELD_OUT + 2) % 4
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return texts.join(F.broadcast(chosen.withColumn("calibrates", calibrates)), "id").select("text", "y", "calibrates")


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Train the dictionaries on a bounded sample; a third of it calibrates. Without both kinds all scores are the base rate."""
    sample = _sample(docs, labels, toxic_rows, ordinary_rows)
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER + MARKS, _LOWER + " " * len(MARKS))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    train = sample.where("NOT calibrates")
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nt, no = size.get(1, 0), size.get(0, 0)
    if not nt or not no:
        return Model(b"", b"", np.zeros(5), 0.0 if not nt and not no else (4.0 if nt else -4.0))
    seen = train.select("y", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")
    )
    seen = seen.where(F.col("t") + F.col("o") >= LEAST_DOCS).withColumn("ratio", (F.col("t") + 0.1) / nt / ((F.col("o") + 0.5) / no))
    top = lambda rows, by: [r["word"].encode() for r in rows.orderBy(F.desc(by), "word").limit(n).collect()]
    n = OWN
    toxic = top(seen.where((F.col("t") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO)), "t")
    n = max(len(toxic), 1)
    ordinary = top(seen.where((F.col("o") >= LEAST_DOCS) & (F.col("ratio") <= 1 / LEAST_RATIO)), "o")
    n = COMMON
    common = top(seen.where((F.col("ratio") < 2) & (F.col("ratio") > 0.5)), "o")
    both = digests(common[::-1]).tobytes()  # the most frequent words last, where they are nearest to a window
    model = Model(digests(toxic[::-1]).tobytes() + both, digests(ordinary[::-1]).tobytes() + both, np.zeros(5), 0.0)

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "gain": list(model.gains(batch["text"].tolist()))})

    rows = sample.where("calibrates").select("text", "y").mapInPandas(gains, "y int, gain array<double>").toPandas()
    if rows["y"].nunique() == 2:
        model.weights, model.start = logistic(np.stack(rows["gain"]), rows["y"].to_numpy(float))
    else:
        model.start = float(np.log(nt / no))
    return model


def classify(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted; one row per row of ``docs``.

    Every window of the whole text counts. Null and empty texts save nothing and get
    the score of such a text. Repeated rows get equal scores; a null doc_id is not
    held out. Only doc_id and text are read, so other names cannot clash. An empty
    table gives no rows. Without labelled rows every score is 0.5, without rows of
    both kinds it is near the only kind's label.
    """
    model = fit(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(batch["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, "doc_id long, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least_score).cast("int").alias("predicted"),
    )
