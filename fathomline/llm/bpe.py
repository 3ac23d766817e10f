"""Byte-level BPE encoding and decoding as a tree reduction.

The tokens of a text form a monoid: the halves of a text are encoded apart and joined. A join encodes a
window around the boundary anew and grows it on both sides until it ends at places where tokens outside
cannot change; everything outside is taken over. Decoding concatenates the bytes of the halves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.minhash import slices
from fathomline.llm.words import map_batches

# Code points of a leaf, and tokens of a leaf when decoding.
LEAF = 4096
# Longer windows (one run of letters or blanks) are matched by a matcher without a backtracking limit.
LONG_WINDOW = 65_536
_STEP = 64

# A letter or digit before one of these is always followed by the start of a match: the only match that
# holds a letter and anything after it is a run of letters, and likewise for digits. A run of blanks does
# not reach back over a letter and looks one code point ahead, which both halves of a cut here still see.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \t\n\r!-/:-@\[-`{-~])")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Codec:
    """Encoder and decoder for one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._length = np.array([len(x) for x in self._bytes], dtype=np.int64)
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._pieces = regex.compile(spaces)

    def _window(self, text: str) -> np.ndarray:
        if len(text) <= LONG_WINDOW:
            return np.array(self._leaf.encode_ordinary(text), dtype="<u4")
        ids: list[int] = []
        for match in self._pieces.finditer(text):
            ids += self._leaf._encode_single_piece(match.group().encode())
        return np.array(ids, dtype="<u4")

    def _join(self, text: str, start: int, at: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of ``text[start:end]`` from those of ``text[start:at]`` and ``text[at:end]``."""
        low, reach = start, _STEP
        while True:
            edge = max(start, at - reach)
            safe = [m.start() for m in _SAFE.finditer(text, edge + 1, at)]
            if safe or edge == start:
                low = safe[-1] if safe else start
                break
            reach *= 2
        found = _SAFE.search(text, at + 1, end)
        high = found.start() if found else end
        middle = self._window(text[low:high])
        drop_left, drop_right = len(text[low:at].encode()), len(text[at:high].encode())
        keep, skip = len(left), 0
        while drop_left > 0:
            keep -= 1
            drop_left -= self._length[left[keep]]
        while drop_right > 0:
            drop_right -= self._length[right[skip]]
            skip += 1
        if drop_left or drop_right:
            raise ValueError("a window does not end between tokens")
        return np.concatenate([left[:keep], middle, right[skip:]])

    def encode(self, text: str, start: int = 0, end: int | None = None) -> np.ndarray:
        """Token ids of ``text[start:end]`` as little-endian unsigned 32-bit integers."""
        end = len(text) if end is None else end
        if end - start <= LEAF:
            return self._window(text[start:end])
        at = (start + end) // 2
        return self._join(text, start, at, end, self.encode(text, start, at), self.encode(text, at, end))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; those of an unknown id are an error."""
        if len(ids) <= LEAF:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        at = len(ids) // 2
        return self.decode(ids[:at]) + self.decode(ids[at:])


_codecs: dict[int, Codec] = {}


def _codec(vocabulary: Broadcast, pattern: str) -> Codec:
    """One codec for each process and vocabulary."""
    key = hash((vocabulary.value, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(vocabulary.value), pattern)
    return _codecs[key]


def _over(vocabulary: Broadcast, pattern: str, name: str, work: Callable[[Codec, pa.Scalar], bytes]):
    """A map over Arrow batches that replaces the last column by the binary column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in slices(batches, 128):
            out = pa.array([work(codec, x) for x in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), out], names=[batch.schema.names[0], name])

    return run


def _encoded(codec: Codec, text: pa.Scalar) -> bytes:
    return codec.encode(text.as_py() or "").tobytes()


def _decoded(codec: Codec, ids: pa.Scalar) -> bytes:
    return codec.decode(np.frombuffer(ids.as_py() or b"", dtype="<u4"))


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids), one row for each row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    ``vocabulary`` holds the bytes of a rank file, a few hundred kilobytes at any size of the corpus. A
    null or empty text has no tokens; a row without an id stays. Special tokens are not recognised, other
    columns are ignored and an empty table gives an empty result. A text is never cut: a long one is a
    deeper tree, and only its windows are encoded more than once.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.transform(map_batches, _over(vocabulary, pattern, "ids", _encoded), "doc_id long, ids binary")


def decode(tokens: DataFrame, vocabulary: Broadcast, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of the tokens of each row; null ids decode to no bytes."""
    rows = tokens.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids"))
    return rows.transform(map_batches, _over(vocabulary, pattern, "decoded", _decoded), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens of each text and what they decode to, in one pass without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in slices(batches, 128):
            ids = [_encoded(codec, x) for x in batch.column(1)]
            back = [codec.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id long, ids binary, decoded binary")
