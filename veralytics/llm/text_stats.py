"""Statistics of whole texts, taken in vectorised steps inside tasks.

Words are runs of bytes other than space and ``\\t`` to ``\\r``, which is what
``bytes.split`` gives. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from veralytics.llm.common import chunks

WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "exclaim_rate", "pipe_rate", "stop_rate",
    "comma_rate", "other_mark_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "top_word_rate", "line_words",
    "short_rate", "long_rate", "wide_rate", "same_next_rate", "byte_entropy",
]

_SPACE = np.array([32, *range(9, 14)])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>!.,"])


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _ids(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def repeated_words(doc: np.ndarray, code: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows of ``window`` words found twice or more in it.

    Windows are named exactly, by pairs of names of half their length (``window`` is a power of two).
    """
    n = len(code)
    if n < window:
        return np.zeros(n_docs, np.int64)
    name, step = _ids(doc * (code.max() + 1) + code), 1
    while step < window:
        name = _ids(name[: len(name) - step] * (name.max() + 1) + name[step:])
        step *= 2
    inside = doc[: len(name)] == doc[window - 1 :]
    again = inside & (np.bincount(name[inside], minlength=name.max() + 1)[name] >= 2)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def text_stats(texts: list[str | None]) -> pd.DataFrame:
    """One row per text: the counts ``BASE`` as integers and the measures ``FEATURES``."""
    parts = [_chunk_stats([(t or "").encode() for t in texts[s]]) for s in chunks(texts)]
    columns = BASE + FEATURES
    out = np.concatenate(parts) if parts else np.zeros((0, len(columns)))
    frame = pd.DataFrame(out, columns=columns)
    return frame.astype(dict.fromkeys(BASE, np.int64))


def _chunk_stats(texts: list[bytes]) -> np.ndarray:
    n_docs = len(texts)
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    doc = np.repeat(np.arange(n_docs), n)
    code, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
    code = code.astype(np.int64)
    byte = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    points = byte[:, :128].sum(1) + byte[:, 192:].sum(1)
    chars = points - byte[:, _SPACE].sum(1)
    symbols = byte[:, _SYMBOLS].sum(1)
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    repeats = repeated_words(doc, code, n_docs)

    length = np.array([len(w) for w in distinct], np.int64)[code] if words else np.zeros(0, np.int64)
    pair = _ids(doc * (len(distinct) + 1) + code)
    per_pair = np.bincount(pair) if words else np.zeros(0, np.int64)
    pair_doc = np.zeros(len(per_pair), np.int64)
    pair_doc[pair] = doc
    top = np.zeros(n_docs)
    np.maximum.at(top, pair_doc, per_pair)
    same = np.zeros(len(doc), bool)
    same[1:] = (pair[1:] == pair[:-1]) if words else False
    share = byte / np.maximum(byte.sum(1), 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)

    w, c, ln = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines[:, 0], 1)
    count = lambda mask: np.bincount(doc[mask], minlength=n_docs)
    measures = [
        np.log1p(n), chars / w, symbols / w, byte[:, 65:91].sum(1) / c, byte[:, 48:58].sum(1) / c, byte[:, 33] / w,
        byte[:, 124] / w, byte[:, 46] / w, byte[:, 44] / w, byte[:, _MARKS].sum(1) / w, lines[:, 1] / ln, repeats / w,
        np.bincount(pair_doc, minlength=n_docs) / w, top / w, n / ln, count(length <= 2) / w, count(length > 12) / w,
        byte[:, 192:].sum(1) / c, count(same) / w, entropy,
    ]
    return np.column_stack([n, chars, symbols, lines[:, 1], repeats, *measures]).astype(float)
