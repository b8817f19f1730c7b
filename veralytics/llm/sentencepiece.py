"""SentencePiece encoding and decoding by a Viterbi pass over a trie of marked words.

A text's words, marked with U+2581 in place of the spaces before them, repeat a
lot and share beginnings. Each batch sorts its distinct marked words and walks
the trie that they form depth first: the forward state of a prefix is computed
once and serves every word that begins with it.

For a unigram model the forward state of a prefix is the best sum of scores and
the last piece of the best split. A BPE model's split of a prefix is not a best
sum; its forward state is the last piece alone, which is the only piece that fits
behind the split of what precedes it (two neighbours fit if merging their joint
text ends in just these two). Both give what the model's own library gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import CHUNK_CHARS, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Marked words whose pieces, and pairs of pieces whose fit, a worker remembers.
REMEMBERED, REMEMBERED_PAIRS = 400_000, 2_000_000
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """A model's pieces, read on the driver once; its size is the model's, not the data's."""

    ids: dict[str, int]
    scores: list[float]
    spoken: list[bytes]
    byte_ids: list[int]
    unknown: int
    kind: int
    dummy_prefix: bool
    separators: str
    whole: bool
    fits_: dict[int, bool] = field(default_factory=dict)
    tree: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        kinds = pb.ModelProto.SentencePiece
        ids, scores, spoken, byte_ids, unknown = {}, [], [], [-1] * 256, 0
        for i, p in enumerate(model.pieces):
            scores.append(p.score)
            out = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:-1], 16)] = i
                out = bytes([int(p.piece[3:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                unknown, out = i, " ⁇ ".encode()
            elif p.type == kinds.CONTROL:
                out = b""
            elif p.type != kinds.UNUSED:
                ids[p.piece] = i
            spoken.append(out)
        used = set("".join(ids))
        out = cls(
            ids, scores, spoken, byte_ids, unknown, model.trainer_spec.model_type, spec.add_dummy_prefix,
            "".join(c for c in "\n\t\r" if c not in used),
            any(MARK in p.lstrip(MARK) for p in ids),
        )
        for piece, i in ids.items():
            if out.kind == UNIGRAM or out.fits("", piece):  # merging never ends in the others
                node = out.tree
                for char in piece[:-1]:
                    node = node.setdefault(char, ({}, -1))[0]
                node[piece[-1]] = (node.get(piece[-1], ({}, -1))[0], i)
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text: no piece spans two of them."""
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if self.whole:
            return [marked]
        sep = re.escape(self.separators)
        own = f"|[{sep}]" if sep else ""
        return re.findall(rf"{MARK}+[^{MARK}{sep}]*|[^{MARK}{sep}]+{own}", marked)

    def merged(self, text: str) -> list[str]:
        """A short text's split by merging, always the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                n = self.ids.get(parts[i] + parts[i + 1])
                if n is not None and self.scores[n] > best:
                    best, at = self.scores[n], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can follow ``before`` in a split by merging."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def spell(self, char: str) -> list[int]:
        """The ids of a character that is no piece: its bytes if the model has them."""
        raw = [self.byte_ids[b] for b in char.encode()]
        return raw if min(raw) >= 0 else [self.unknown]

    def split_all(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct marked words, by a depth-first walk of their trie.

        Pieces are named by id, a character that is no piece by -1.
        """
        out, scores, unigram, known, tree = {}, self.scores, self.kind == UNIGRAM, self.fits_, self.tree
        worst = min(scores) - UNKNOWN_PENALTY
        # By length of the prefix: last piece and its length, sum of scores, and pieces that have begun and may go on.
        last, size, best, begun = [-1], [0], [0.0], [[]]
        before = ""
        for word in sorted(words):
            top = min(len(word), len(before))
            same = 0
            while same < top and word[same] == before[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :], best[same + 1 :], begun[same + 1 :]
            active = begun[same]
            for end in range(same + 1, len(word) + 1):
                char, found, long, high, going = word[end - 1], -1, 1, -np.inf, []
                for start, children in [*active, (end - 1, tree)]:  # the longest piece first
                    step = children.get(char)
                    if step is None:
                        continue
                    child, piece = step
                    if child:
                        going.append((start, child))
                    if piece < 0 or found >= 0 and not unigram:
                        continue
                    if unigram:
                        total = best[start] + scores[piece]
                        if total > high:
                            found, long, high = piece, end - start, total
                        continue
                    fits = True if start == 0 else known.get(last[start] << 32 | piece) if last[start] >= 0 else None
                    if fits is None:
                        fits = self.fits(word[start - size[start] : start], word[start:end])
                        if last[start] >= 0:
                            known[last[start] << 32 | piece] = fits
                    if fits:
                        found, long = piece, end - start
                if unigram and (found < 0 or best[end - 1] + worst > high):
                    found, long, high = -1, 1, best[end - 1] + worst
                last.append(found)
                size.append(long)
                best.append(high)
                begun.append(going)
                active = going
            ids, end = [], len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += reversed(self.spell(word[end - 1]))
                end -= size[end]
            out[word] = ids[::-1]
            before = word
        if len(known) > REMEMBERED_PAIRS:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.spoken[i] for i in ids])
        if self.dummy_prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode(errors="replace")


class Encoder:
    """Encodes lists of texts inside a task; a worker remembers words that it has split from task to task."""

    kept: dict[str, Encoder] = {}

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.known, self.remembered = vocabulary, {}, remembered

    @classmethod
    def of(cls, path: str, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> Encoder:
        name = f"{path}:{len(vocabulary.ids)}:{hash(tuple(vocabulary.scores))}:{remembered}"
        if name not in cls.kept:
            cls.kept = {name: cls(vocabulary, remembered)}
        return cls.kept[name]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        v = self.vocabulary
        split = [v.words(t or "") for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        code, distinct = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
        if len(self.known) > self.remembered:
            self.known.clear()
        self.known.update(v.split_all([w for w in distinct if w not in self.known]))
        pieces = [self.known[w] for w in distinct]
        size = np.array([len(p) for p in pieces], np.int64)
        flat = np.array([n for p in pieces for n in p], np.int32)
        each = size[code] if len(code) else np.zeros(0, np.int64)
        start = (np.cumsum(size) - size)[code] if len(code) else each
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        ends = np.concatenate([[0], np.cumsum(each)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        return flat[np.repeat(start, each) + place] if len(flat) else flat, np.diff(edges)


def encode(docs: DataFrame, model: str = MODEL, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text back), one row per row of ``docs``.

    A null text has null ids, 0 tokens and no round trip (null); an empty one has
    no ids. A text that holds U+2581 itself comes back with spaces there, as with
    any SentencePiece model, so its round trip is false. Repeated rows come out
    alike, only doc_id and text are read, and an empty table gives no rows. A worker
    remembers about ``remembered`` words at most: fewer take less memory and more time.
    """
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model, vocabulary, remembered)
        for batch in batches:
            for part, own in sliced(batch, CHUNK_CHARS):
                flat, counts = encoder(own)
                missing = np.array([t is None for t in own], bool)
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = flat.tolist()
                same = [None if t is None else vocabulary.decode(ids[a:b]) == t for t, a, b in zip(own, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(missing)),
                        pa.array(counts, pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text, bytes that are no UTF-8 give U+FFFD."""
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else vocabulary.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
