"""Toxic text by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all else is unlabelled and holds toxic documents at the
class prior. The classifier is logistic over the presence of words and minimises

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

the risk of negatives being estimated from the unlabelled minus the share of the positives in them and
kept from turning negative, which would be overfitting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from fathomline.llm.minhash import slices
from fathomline.llm.words import drawn, map_batches, mix, refuse, word_hashes
from fathomline.sources.tables import stage

# Documents of the training sample; everything else of the learning side is only counted.
POSITIVES = 3_000
UNLABELLED = 9_000
# Used when no label tells the share of toxic documents.
DEFAULT_PRIOR = 0.1
# A word is a feature when at least so many positives hold it and it is so many times as frequent in them.
LEAST_POSITIVES = 3
LIFT = 3.0
FEATURES = 4_096
EPOCHS = 400
COPY_GROUPS, COPY_MINIMA = 12, 4
_RATE = 0.05
_RIDGE = 3e-4
_LASSO = 1e-3

# letters, digits and all bytes of non-ASCII characters belong to words; A-Z count as a-z
WORD_BYTES = np.zeros(256, dtype=np.uint8)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    WORD_BYTES[_c] = _c
WORD_BYTES[ord("A") : ord("Z") + 1] = WORD_BYTES[ord("a") : ord("z") + 1]


@dataclass
class Model:
    """Sorted word hashes, the weight of each, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _distinct_words(texts: pa.Array) -> list[np.ndarray]:
    words = word_hashes(texts, WORD_BYTES)
    return [np.unique(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [x.tobytes() for x in _distinct_words(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(words, pa.binary())], names=["positive", "words"])


def _without_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """The documents without near copies of earlier ones, so that the words of a copied text count once.

    Documents that agree on a group of minima and share half of their words are copies.
    """
    seeds = mix(np.arange(1, COPY_GROUPS * COPY_MINIMA + 1, dtype=np.uint64))
    kept: list[np.ndarray] = []
    known: dict[tuple, list[int]] = {}
    for own in docs:
        if not len(own):
            continue
        minima = mix(own[None, :] ^ seeds[:, None]).min(axis=1).reshape(COPY_GROUPS, COPY_MINIMA)
        keys = [(k, *row) for k, row in enumerate(minima.tolist())]
        met = {j for key in keys for j in known.get(key, ())}
        if any(3 * len(np.intersect1d(own, kept[j], assume_unique=True)) >= len(own) + len(kept[j]) for j in met):
            continue
        for key in keys:
            known.setdefault(key, []).append(len(kept))
        kept.append(own)
    return kept


def _features(positives: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Words that tell positives apart, by the difference of their document shares."""
    words, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *positives]), return_counts=True)
    common = held >= min(LEAST_POSITIVES, max(1, len(positives)))
    words, held = words[common], held[common]
    seen = np.zeros(len(words))
    for own in others:
        at = np.searchsorted(words, own)
        at = at[at < len(words)]
        hit = at[np.isin(words[at], own, assume_unique=False)]
        seen[np.unique(hit)] += 1
    share, general = held / max(1, len(positives)), seen / max(1, len(others))
    # both shares are estimates: take the cautious end of each
    low = share - 2 * np.sqrt(share * (1 - share) / max(1, len(positives)))
    high = general + np.sqrt(general * (1 - general) / max(1, len(others))) + 1 / max(1, len(others))
    good = np.flatnonzero(low > LIFT * high)
    best = good[np.argsort(-(share - general)[good], kind="stable")[:FEATURES]]
    return np.sort(words[best])


def _rows(docs: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every feature present."""
    doc, feature = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, own in enumerate(docs):
        at = np.searchsorted(words, own)
        ok = at < len(words)
        at, own = at[ok], own[ok]
        at = at[words[at] == own]
        doc.append(np.full(len(at), k)), feature.append(at)
    return np.concatenate(doc), np.concatenate(feature)


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit the classifier; each document is its sorted distinct word hashes."""
    positives = _without_copies(positives)
    words = _features(positives, unlabelled) if positives else np.zeros(0, np.uint64)
    if not len(words) or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    n_p, n_u = len(positives), len(unlabelled)
    doc, feature = _rows([*positives, *unlabelled], words)
    weights, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(doc, weights[feature], minlength=n_p + n_u)
        chance = 1 / (1 + np.exp(-z))
        loss_minus = np.logaddexp(0, z)
        risk = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
        # gradients of the losses log(1 + exp(-z)) and log(1 + exp(z))
        pull = np.zeros(n_p + n_u)
        if risk >= 0:
            pull[:n_p] = prior * (chance[:n_p] - 1) / n_p - prior * chance[:n_p] / n_p
            pull[n_p:] = chance[n_p:] / n_u
        else:
            pull[:n_p] = prior * chance[:n_p] / n_p
            pull[n_p:] = -chance[n_p:] / n_u
        grad = np.append(np.bincount(feature, pull[doc], minlength=len(words)) + _RIDGE * weights * prior, pull.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
        weights = np.sign(weights) * np.maximum(np.abs(weights) - _RATE * _LASSO, 0)
    return Model(words, weights, bias, prior)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = word_hashes(batch.column(batch.num_columns - 1), WORD_BYTES)
            z = np.full(batch.num_rows, model.bias)
            if len(model.words) and len(words.hashes):
                at = np.minimum(np.searchsorted(model.words, words.hashes), len(model.words) - 1)
                hit = np.flatnonzero(model.words[at] == words.hashes)
                doc = np.searchsorted(words.first, hit, side="right") - 1
                pairs = np.unique(doc * len(model.words) + at[hit])
                z += np.bincount(pairs // len(model.words), model.weights[pairs % len(model.words)], minlength=len(z))
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names[:-1], "score"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column]) -> Model:
    """Train on documents for whose id ``learn`` holds.

    ``labels`` has doc_id and toxic; toxic = 1 confirms a positive, the share of 1 among the learnable
    labels is the prior. Nulls in either are no label. The training sample is bounded by ``POSITIVES``
    and ``UNLABELLED`` documents, drawn by a hash of the id, so the ids sent to the scan are few at any size;
    of rows that repeat an id, only so many come to the driver as the bounds allow.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").alias("_toxic"))
    known = known.where("_doc IS NOT NULL AND _toxic IS NOT NULL").where(learn(F.col("_doc")))
    total, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("_toxic") == 1, 1).otherwise(0))).first()
    prior = min(max(toxic / total, 0.001), 0.9) if total and toxic else DEFAULT_PRIOR
    chosen = known.where("_toxic = 1").select("_doc").distinct().orderBy(F.xxhash64("_doc"), "_doc").limit(POSITIVES)
    others = (
        docs.select(F.col("doc_id").cast("long").alias("_doc"))
        .where("_doc IS NOT NULL")
        .where(learn(F.col("_doc")))
        .orderBy(F.xxhash64("_doc", F.lit(1)), "_doc")
        .limit(UNLABELLED)
    )
    sample = chosen.select("_doc", F.lit(True).alias("positive")).unionByName(
        others.distinct().select("_doc", F.lit(False).alias("positive"))
    )
    # at most POSITIVES + UNLABELLED rows of nine bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_doc")
    )
    present = stage(texts.select("positive", "text").transform(map_batches, _present, "positive boolean, words binary"), "toxic-sample")
    # an id may stand for any number of rows: the bounds hold for what is collected
    bounded = drawn(present.where("positive"), POSITIVES, "words").unionByName(drawn(present.where("NOT positive"), UNLABELLED, "words"))
    rows = bounded.collect()
    sets = [(r.positive, np.frombuffer(r.words, np.uint64)) for r in rows]
    order = sorted(range(len(sets)), key=lambda k: (not sets[k][0], len(sets[k][1]), bytes(rows[k].words[:64])))
    return train([sets[k][1] for k in order if sets[k][0]], [sets[k][1] for k in order if not sets[k][0]], prior)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``, the chance that the text is toxic.

    A null or empty text has no features and gets the score of the bias, the same for all of them. Texts are
    read whole, however long; repeated rows are scored alike; an empty table stays empty. ``keep`` may name any
    columns but ``score``.
    """
    refuse(keep, "score")
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.transform(map_batches, _scores(model), StructType([docs.schema[c] for c in keep]).add("score", "double"))
