"""Language of text by a sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of one to three letters with word boundaries. Their document frequencies are
counted over all learnable documents; the weights are trained by follow-the-regularised-leader with
elastic-net penalties, document by document, on a bounded sample; a temperature fitted on other
documents of that sample calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from fathomline.llm.minhash import slices
from fathomline.llm.words import map_batches, mix, refuse
from fathomline.sources.tables import stage

BUCKETS = 1 << 15
LONGEST = 3
# Documents of each language in the training sample, one in HELD of which only calibrates.
SAMPLE = 1_500
HELD = 5
# Documents of all languages together: with more than 40 languages each gets fewer.
TOTAL = 60_000
# Features of a document of the training sample: all distinct ones; pieces of long texts are not left out.
PASSES = 3
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _letters() -> np.ndarray:
    """Which code points below 0x20000 are letters; those above count as letters."""
    return np.array([chr(c).isalpha() for c in range(0x20000)])


_IS_LETTER: list[np.ndarray] = []


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in the text and their counts; other characters only separate words."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    points = _code_points(text)
    letter = (points >= 0x20000) | _IS_LETTER[0][np.minimum(points, 0x1FFFF)]
    # one mark for any run of other characters, and one at both ends
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint64)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    key = np.zeros(len(line), np.uint64)
    for size in range(1, LONGEST + 1):
        key = (key[: len(line) - size + 1] + line[size - 1 :] + np.uint64(1)) * _GOLDEN
        found.append(mix(key) & np.uint64(BUCKETS - 1))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0):
            at, _ = features(text.as_py() or "")
            total[at] += 1
            docs += bool(len(at))
    at = np.flatnonzero(total)
    yield pa.record_batch(
        [pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["bucket", "documents"]
    )


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = features(text)
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((x**2).sum())
    return at, x / norm if norm else x


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_vector(t.as_py() or "", idf) for t in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1),
                    pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()),
                    pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary()),
                ],
                names=["doc_id", "lang", "at", "x"],
            )

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and bias by FTRL-proximal, one document after another."""
    z, g2 = np.zeros((BUCKETS + 1, n)), np.zeros((BUCKETS + 1, n))

    def solved(at: np.ndarray) -> np.ndarray:
        lasso = np.where(at == BUCKETS, 0.0, LASSO)[:, None]
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - lasso, 0)
        return -shrunk / ((BETA + np.sqrt(g2[at])) / ALPHA + RIDGE)

    for turn in range(PASSES):
        for k in np.random.default_rng(turn).permutation(len(docs)):
            at = np.append(docs[k][0], BUCKETS)  # the last is the bias
            x = np.append(docs[k][1], 1.0)
            w = solved(at)
            p = _softmax(x @ w)
            p[classes[k]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(g2[at] + g**2) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g**2
    w = solved(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss on held-back documents, by golden-section-free grid refinement."""
    if not len(classes):
        return 1.0
    low, high = np.log(0.05), np.log(20.0)
    for _ in range(4):
        grid = np.linspace(low, high, 21)
        loss = [-np.log(_softmax(logits / np.exp(t))[np.arange(len(classes)), classes] + 1e-12).mean() for t in grid]
        best = int(np.argmin(loss))
        low, high = grid[max(0, best - 1)], grid[min(20, best + 1)]
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, learn: Callable[[Column], Column]) -> Model:
    """Train on documents for whose id ``learn`` holds; rows without id, text or lang are left out.

    Document frequencies cover all of them; the sample for the weights is bounded to ``SAMPLE`` documents
    of each language and ``TOTAL`` of all, drawn by a hash of the id, whatever repeats.
    """
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where(learn(F.col("doc_id"))).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counted = known.select("text").transform(map_batches, _frequencies, "bucket long, documents long")
    # BUCKETS + 1 rows at most
    counts = {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("documents").alias("n")).collect()}
    frequency = np.zeros(BUCKETS)
    for bucket, n in counts.items():
        if bucket >= 0:
            frequency[bucket] = n
    idf = np.log((1 + counts.get(-1, 0)) / (1 + frequency)) + 1
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    share = max(1, min(SAMPLE, TOTAL // len(languages)))
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # one pass for all languages; each task keeps its first of every language before the shuffle
    ids = known.select("lang", "doc_id").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= share)
    chosen = known.join(F.broadcast(ids.select(F.col("doc_id").alias("_doc")).distinct()), F.col("doc_id") == F.col("_doc"))
    vectors = stage(
        chosen.select("doc_id", "lang", "text").transform(map_batches, _vectors(idf), "doc_id long, lang string, at binary, x binary"),
        "language-sample",
    )
    # an id may stand for any number of rows: the bound holds for what is collected
    again = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "at", "x")
    rows = vectors.withColumn("_k", F.row_number().over(again)).where(F.col("_k") <= share).drop("_k").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r["at"]), bytes(r.x)))
    vectors = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float)) for r in rows]
    classes = np.array([languages.index(r.lang) for r in rows], dtype=np.int64)
    held = np.arange(len(rows)) % HELD == HELD - 1
    weights, bias = train([v for v, h in zip(vectors, held) if not h], classes[~held], len(languages))
    logits = np.array([x @ weights[at] + bias for (at, x), h in zip(vectors, held) if h]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, _temperature(logits, classes[held]))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``lang_pred`` and ``score``, the calibrated chance of that language.

    A null text, one without letters and every text of a model without languages is ``und`` with score 0.
    Of equally likely languages the first in alphabetical order wins. Texts are read whole, however long;
    repeated rows get the same; an empty table stays empty. ``keep`` may name any columns but those two.
    """
    refuse(keep, "lang_pred", "score")
    used = np.flatnonzero(np.abs(model.weights).sum(axis=1)) if model.languages else np.zeros(0, np.int64)
    # only the rows of features in use travel
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    weights, idf = model.weights[used], model.idf
    languages, bias, temperature = model.languages, model.bias, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                at, x = _vector(text.as_py() or "", idf)
                if not len(at) or not languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                ok = place[at] >= 0
                p = _softmax((x[ok] @ weights[place[at[ok]]] + bias) / temperature)
                best = int(np.argmax(p))
                names.append(languages[best]), scores.append(float(p[best]))
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).transform(map_batches, run, schema)
