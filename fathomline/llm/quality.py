"""Quality of text from how well it compresses with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text. A text is cut into short blocks, so that the
dictionary counts in all of them, and compressed with both; the difference of the two sizes over their
sum, turned into a probability by a logistic curve fitted on other labelled text, is the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from fathomline.llm.minhash import slices
from fathomline.llm.words import drawn, map_batches, refuse
from fathomline.sources.tables import stage

# Labelled documents of each class for the dictionaries, and as many for the calibration.
SAMPLE = 1_500
# The texts of the dictionary sample are cut into pieces of so many bytes; of each class at most so many pieces
# of all its texts together are trained on.
PIECES, PIECE_BYTES = 4 * SAMPLE, 4096
DICTIONARY_BYTES = 32_768
BLOCK_BYTES = 512
LEVEL = 3


@dataclass
class Model:
    """Dictionaries (None: nothing to tell apart) and the logistic curve of the size difference."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    # a trained dictionary starts with a magic number and is known by it, anything else counts as content
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with bad - size with good) / (their sum) over all blocks; 0 for an empty text."""
    with_good = with_bad = 0
    for at in range(0, len(text), BLOCK_BYTES):
        block = text[at : at + BLOCK_BYTES]
        with_good += len(good.compress(block))
        with_bad += len(bad.compress(block))
    return (with_bad - with_good) / (with_bad + with_good) if text else 0.0


def _differences(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _compressor(good), _compressor(bad)
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            x = [difference((t.as_py() or "").encode(), one, two) for t in texts]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(x, pa.float64())], names=[*batch.schema.names[:-1], "_difference"]
            )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        labels, out = [], []
        for quality, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode()
            for start in range(0, len(data), PIECE_BYTES):
                labels.append(quality), out.append(data[start : start + PIECE_BYTES])
        yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], names=["quality", "piece"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, the labels being smoothed as Platt does."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, design.T @ (p - target)), -5, 5)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column]) -> Model:
    """Train on labelled documents for whose id ``learn`` holds; null labels and ids are none.

    The training sample is bounded: ``SAMPLE`` documents of each class for the dictionaries and as many for
    the curve, drawn by a hash of the id; ``PIECES`` pieces of each class, of any of its texts and any place in
    them, and twice ``SAMPLE`` size differences come to the driver, whatever repeats. Without documents of both classes the score is their share.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").cast("int").alias("quality"))
    known = known.where("_doc IS NOT NULL AND quality IN (0, 1)").where(learn(F.col("_doc"))).distinct()
    parts = []
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(F.xxhash64("_doc"), "_doc").limit(2 * SAMPLE)
        parts.append(part)
    sample = parts[0].unionByName(parts[1]).withColumn("use", F.pmod(F.xxhash64("_doc", F.lit(7)), F.lit(2)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_doc")  # at most four samples of a few bytes a row
    )
    cut = texts.where("use = 0").select("quality", "text").transform(map_batches, _pieces, "quality int, piece binary")
    cut = stage(cut, "quality-pieces")
    # an id may stand for any number of rows, and a text may be long: the bounds hold for what is collected
    rows = [r for q in (0, 1) for r in drawn(cut.where(F.col("quality") == q), PIECES, "piece").collect()]
    pieces = {q: sorted(bytes(r.piece) for r in rows if r.quality == q) for q in (0, 1)}
    total, ones = known.agg(F.count("*"), F.sum("quality")).first()
    share = (ones + 1) / (total + 2) if total else 0.5
    if not pieces[0] or not pieces[1]:
        return Model(None, None, 0.0, float(np.log(share / (1 - share))))
    good, bad = _dictionary(pieces[1]), _dictionary(pieces[0])
    rest = texts.where("use = 1").select("quality", "text").transform(
        map_batches,
        _differences(good, bad), "quality int, _difference double"
    )
    rest = stage(rest, "quality-differences")
    curve = [r for q in (0, 1) for r in drawn(rest.where(F.col("quality") == q), 2 * SAMPLE, "_difference").collect()]
    found = sorted((r["_difference"], r.quality) for r in curve)
    x, y = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    if not len(x) or y.min() == y.max():
        return Model(None, None, 0.0, float(np.log(share / (1 - share))))
    return Model(good, bad, *_logistic(x, y))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``, the chance that the text is good.

    The whole text is compressed, however long. A null or empty text differs by 0, so all of them get the same
    score; repeated rows are scored alike; an empty table stays empty. ``keep`` may name any columns but
    ``score``.
    """
    refuse(keep, "score")
    kept = StructType([docs.schema[c] for c in keep])
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    if model.good is None:
        found = rows.withColumn("_difference", F.lit(0.0)).drop("_text")
    else:
        found = rows.transform(map_batches, _differences(model.good, model.bad), kept.add("_difference", "double"))
    z = F.col("_difference") * model.slope + model.offset
    return found.select(*keep, (1 / (1 + F.exp(-z))).alias("score"))
