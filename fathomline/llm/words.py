"""Words and word hashes of a column of texts, as numpy arrays over its Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Rows of an Arrow batch on their way to a task: texts of some kilobytes make a few megabytes.
BATCH_ROWS = 512
_SEED = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def map_batches(df: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with small batches.

    The default of 10,000 rows holds a batch of texts several times over, outside of Spark's memory
    management. The setting stays in the session, as it is read when the plan runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def drawn(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, those of the smallest hashes of ``columns``: a sample whose bound holds whatever the
    rows repeat."""
    return rows.orderBy(F.xxhash64(*columns), *columns).limit(n)


def refuse(keep: tuple[str, ...], *names: str) -> None:
    """Columns that a result is to keep must not have the names of its own."""
    clash = sorted(set(keep) & set(names))
    if clash:
        raise ValueError(f"columns to keep are named as columns of the result: {clash}")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Word hashes of all texts one after another; text ``i`` owns ``hashes[first[i]:first[i + 1]]``.

    ``starts`` and ``ends`` are byte positions of the words in ``data``.
    """

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the offsets of its texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(column: pa.Array, table: np.ndarray) -> Words:
    """Split every text into maximal runs of word bytes and hash the runs.

    ``table`` maps each byte to the byte that counts, 0 for a separator. A hash covers all bytes of its
    word: eight at a time are mixed in, for all words together.
    """
    data, bounds = text_bytes(column)
    mapped = table[data]
    inside = np.zeros(len(mapped) + 2, dtype=bool)
    inside[1:-1] = mapped != 0
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    # a text that follows another without a separator starts a word of its own
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(mapped))]
    begins[cut] = inside[1:-1][cut]
    stops[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(hash_runs(mapped, starts, ends), np.searchsorted(starts, bounds).astype(np.int64), starts, ends, data)


def hash_runs(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``mapped[starts:ends]``."""
    padded = np.zeros(len(mapped) + 8, dtype=np.uint8)
    padded[: len(mapped)] = mapped
    lanes = np.ndarray(shape=(len(mapped) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    hashes = left.astype(np.uint64) * _SEED
    alive, at = None, starts
    while len(at):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        if alive is None:
            hashes = mix(hashes ^ lane)
        else:
            hashes[alive] = mix(hashes[alive] * _SEED ^ lane)
        more = np.flatnonzero(left > 8)
        alive = more if alive is None else alive[more]
        at, left = at[more] + 8, left[more] - 8
    return hashes


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; shorter input is one run of all its words."""
    count = max(1, len(words) - size + 1) if len(words) else 0
    width = min(size, len(words))
    out = np.full(count, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = mix(out * _SEED ^ words[k : k + count])
    return out
