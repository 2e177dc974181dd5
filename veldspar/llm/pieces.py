"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The vocabulary and its scores come from a public model file, named by a parameter. A text gets the
model's dummy prefix and falls into marked words: a space and what follows up to the next one (a line
break stands alone, as no piece holds one). The pieces' mark U+2581 is read as the space it stands for,
so a literal U+2581 in a text is like any character without a piece and decoding is exact:
``decode(encode(t)) == t`` for every text. The best segmentation of a word is the one with the largest
sum of piece scores; ties go to the longest last piece. A character that no piece covers costs
``lowest - 10`` a byte and becomes byte pieces.

Viterbi. The distinct new words of a batch are sorted, so neighbours share their prefixes: the traversal
is depth-first over the trie that the sorted list spells out. The forward scores of the common prefix
stay on the stack; only the characters after it are scored. Segmentations are kept in a bounded cache
between batches.

Scale. One narrow pass, no shuffle; a task holds one batch, the words of about ``PART`` characters of it
and the cache of at most ``CACHE`` words. The vocabulary is read by each Python worker from the same path, so it is never
broadcast nor stored in the repository.

Defined results: null text encodes as null (no ids), empty text as an empty list; repeated rows give
repeated output rows; all columns are kept by ``encode``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Place of the public model; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 200_000
PART = 1 << 20
#: Rows of a batch that are Python objects at a time.
ROWS = 500
_WORD = re.compile("\n| [^ \n]*|[^ \n]+")


class Vocabulary:
    def __init__(self, pieces: Iterable[tuple[str, float]], byte_ids: list[int], id_bytes: list[bytes]) -> None:
        self.ids: dict[str, tuple[int, float]] = {}
        for n, (piece, score) in enumerate(pieces):
            if piece:
                self.ids.setdefault(piece.replace(MARK, " "), (n, score))
        self.byte_ids = byte_ids
        self.bytes = id_bytes
        # every ending of a piece; id -1 marks those that are no piece themselves
        self.ends: dict[str, tuple[int, float]] = {p[i:]: (-1, 0.0) for p in self.ids for i in range(len(p))}
        self.ends.update(self.ids)
        self.unknown = min((s for _, s in self.ids.values()), default=0.0) - 10.0
        self.words: dict[str, bytes] = {}

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian 32-bit) of each distinct word."""
        out: dict[str, bytes] = {}
        get, unknown = self.ends.get, self.unknown
        score, begin, piece = [0.0], [0], [-1]  # of the path's prefixes: best sum, start and id of the last piece
        last = ""
        for word in sorted(words):
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            del score[common + 1 :], begin[common + 1 :], piece[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                char = word[end - 1]
                best = score[end - 1] + (unknown if char < "\x80" else unknown * len(char.encode()))
                at, chosen = end - 1, -1
                for start in range(end - 1, -1, -1):
                    found = get(word[start:end])
                    if found is None:  # no piece ends like this, so none that begins earlier fits either
                        break
                    number, worth = found
                    if number >= 0 and score[start] + worth >= best:
                        best, at, chosen = score[start] + worth, start, number
                score.append(best)
                begin.append(at)
                piece.append(chosen)
            ids: list[int] = []
            end = len(word)
            while end:
                if piece[end] >= 0:
                    ids.append(piece[end])
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(word[begin[end] : end].encode()))
                end = begin[end]
            ids.reverse()
            out[word] = np.array(ids, "<i4").tobytes()
            last = word
        return out

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text; about ``PART`` characters at a time are held as words."""
        out: list[bytes | None] = []
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size >= PART:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str | None]) -> list[bytes | None]:
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        known = self.words
        new = {w for w in chain.from_iterable(split) if w not in known}
        if len(known) + len(new) > CACHE:
            new = set(chain.from_iterable(split))
            known.clear()
        known.update(self.segment(list(new)))
        get = known.__getitem__
        return [None if t is None else b"".join(map(get, words)) for t, words in zip(texts, split)]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        whole = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return whole[1:].decode("utf-8") if whole else ""


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [0] * 256
    pieces, spelled = [], []
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(("", 0.0))
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            pieces.append(("", 0.0))
            spelled.append(b"")
        else:
            pieces.append((piece, model.get_score(i)))
            spelled.append(piece.replace(MARK, " ").encode())
    return Vocabulary(pieces, byte_ids, spelled)


def ids(text: Column, model: str = MODEL) -> Column:
    """The array of piece ids of a text."""

    def lists(texts: list[str | None]) -> pa.ListArray:
        found = load(model).encode(texts)
        lengths = [0 if f is None else len(f) // 4 for f in found]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(f for f in found if f), "<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([f is None for f in found], pa.bool_()))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        # a few hundred rows at a time are Python objects, the rest stays Arrow
        parts = [lists(texts.slice(a, ROWS).to_pylist()) for a in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(text.cast("string"))


def text_of(ids_: Column, model: str = MODEL) -> Column:
    """The text of an array of piece ids."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        vocabulary = load(model)
        return pa.array([None if x is None else vocabulary.decode(np.array(x, "<i4").tobytes()) for x in lists.to_pylist()], pa.string())

    return run(ids_)


def encode(docs: DataFrame, text: str = "text", into: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """``docs`` and the array of piece ids of each text."""
    return docs.withColumn(into, ids(F.col(f"`{text}`"), model))


def decode(df: DataFrame, column: str = "piece_ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` and the text of each array of piece ids."""
    return df.withColumn(into, text_of(F.col(f"`{column}`"), model))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, the SHA-256 of the ids (little-endian 32-bit) and of the text decoded from them, and whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = vocabulary.encode(texts)
            back = [vocabulary.decode(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if f is None else len(f) // 4 for f in found], pa.int64()),
                    pa.array([None if f is None else hashlib.sha256(f).hexdigest() for f in found], pa.string()),
                    pa.array([None if b is None else hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                    pa.array([b == t for b, t in zip(back, texts)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "exact"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean")
