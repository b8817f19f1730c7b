"""Sets of word shingles as sorted 64-bit hashes, taken in vectorised steps inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from veralytics.llm.common import chunks

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The set of each text: distinct shingles of so many words, or one of all words if there are fewer.

    A-Z count as lower case; a text without words has an empty set.
    """
    for part in chunks(texts):
        split = [(t or "").encode().lower().split() for t in texts[part]]
        flat = [w for ws in split for w in ws]
        value = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            joint = mixed(value)
            for j in range(1, words):
                joint = mixed(joint[: len(joint) - 1] + value[j:]) if len(value) > j else joint[:0]
            start = 0
            for ws in split:
                n = len(ws)
                if n >= words:
                    own = np.sort(joint[start : start + n - words + 1])
                    yield own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif n:
                    one = np.uint64(n)
                    for v in value[start : start + n]:
                        one = mixed(np.array([one + v], np.uint64))[0]
                    yield np.array([one], np.uint64)
                else:
                    yield np.zeros(0, np.uint64)
                start += n


def fingerprint(own: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = mixed(own + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])
