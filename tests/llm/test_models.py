"""Trained filters on small corpora: held-out accuracy, bounded samples, and the edge cases of the docstrings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import language, quality, queries, toxicity


def _learn(doc_id):
    return queries.fold(doc_id, 5) != 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain documents of two languages; a tenth is toxic, an eighth is noise."""
    rng = random.Random(6)
    words = {
        "aa": ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(300)],
        "zz": ["".join(rng.choice("uvwxyzé") for _ in range(rng.randint(2, 7))) for _ in range(300)],
    }
    docs, labels = [], []
    for k in range(600):
        lang = "aa" if k % 3 else "zz"
        own = [rng.choice(words[lang]) for _ in range(rng.randint(30, 90))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for bad in rng.sample(["vilemoron", "grimscum", "foultrash"], 2):
                own.insert(rng.randrange(len(own)), bad.upper() if k % 2 else bad)
        good = int(k % 8 != 0)
        if not good:
            own = [w + rng.choice(["%%%", "###", "$$$", "&&&"]) for w in own]
        docs.append((k, " ".join(own), lang))
        if k % 3:
            labels.append((k, good, toxic if k % 5 else None))
    docs += [(700, None, "aa"), (701, "", "zz"), (702, "123 !!", None), (703, "abc " * 20_000, "aa"), (None, "abc", "aa")]
    labels += [(None, 1, 1), (900, 1, 1), (1, 1, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    return (
        frame.withColumns({"score": F.lit("clash"), "label": F.lit(1)}).cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, _learn)
    assert 0 < model.prior < 0.3
    got = {r.doc_id: r.score for r in toxicity.score(docs.drop("score"), model, "doc_id").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    bad = {k for k, t in texts.items() if any(w in t.lower() for w in ("vilemoron", "grimscum", "foultrash"))}
    flagged = {k for k, s in got.items() if s >= 0.5}
    assert len(flagged & bad) >= 0.95 * len(bad) and len(flagged - bad) <= 0.01 * len(texts)
    assert len(got) == len(texts) and got[700] == got[701] < 0.5
    assert toxicity.score(docs.limit(0), model, "doc_id").count() == 0


def test_toxicity_without_labels(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.limit(0), _learn)
    assert model.prior == toxicity.DEFAULT_PRIOR and len(model.words) == 0
    assert {round(r.score, 6) for r in toxicity.score(docs, model, "doc_id").collect()} == {toxicity.DEFAULT_PRIOR}
    assert toxicity.fit(docs.limit(0), labels, _learn).bias < 0


def test_risk_of_negatives_never_drives_training():
    """A word in all positives and nothing else: weights stay finite however long the training is."""
    positives = [np.array([1, 10 + k], np.uint64) for k in range(50)]
    others = [np.array([10 + k], np.uint64) for k in range(400)] + positives[:20]
    model = toxicity.train(positives, others, 0.1)
    at = {w: x for w, x in zip(model.words.tolist(), model.weights)}
    assert 0 < at[1] < 50 and model.bias + at[1] > 0 > model.bias


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, _learn)
    got = {r.doc_id: r.score for r in quality.score(docs.drop("score"), model, "doc_id").collect()}
    held = [k for k in range(600) if k % 3 == 0]  # rows without labels
    good, bad = [got[k] for k in held if k % 8], [got[k] for k in held if k % 8 == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9  # few labels: the order is learnt before the level
    assert np.mean([g >= 0.3 for g in good]) > 0.95
    assert got[700] == got[701] and all(0 <= s <= 1 for s in got.values()) and len(got) == docs.count()


def test_quality_without_labels(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels.limit(0), _learn)
    assert {r.score for r in quality.score(docs.drop("score"), model, "doc_id").collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1"), _learn)
    assert one.good is None and quality.score(docs.limit(0), one, "doc_id").count() == 0


def test_language(spark, corpus):
    docs, _ = corpus
    model = language.fit(docs, lambda i: queries.fold(i, 3) != 1)
    assert model.languages == ["aa", "zz"]
    # the lasso leaves most of the buckets without weight
    assert (np.abs(model.weights).sum(axis=1) > 0).mean() < 0.5
    got = {r.doc_id: r for r in language.predict(docs.drop("score"), model, "doc_id").collect()}
    held = [k for k in range(600) if k % 3 == 1]
    assert np.mean([got[k].lang_pred == ("aa" if k % 3 else "zz") for k in range(600)]) > 0.98 and held
    for k in (700, 701, 702):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[703].lang_pred == "aa" and got[None].lang_pred == "aa"


def test_language_without_documents(spark, corpus):
    docs, _ = corpus
    model = language.fit(docs.limit(0), lambda i: queries.fold(i, 3) != 1)
    assert {r.lang_pred for r in language.predict(docs.drop("score"), model, "doc_id").collect()} == {"und"}


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 2, 4000)
    sure = np.where(rng.random(4000) < 0.8, classes, 1 - classes)
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), sure] = 8.0  # right in 80 % of cases, but sure of all
    t = language._temperature(logits, classes)
    assert language._softmax(logits / t).max(axis=1).mean() == pytest.approx(0.8, abs=0.02)


def test_difference_of_an_empty_text():
    one = quality._compressor(b"abcdefgh" * 100)
    assert quality.difference(b"", one, one) == 0.0 == quality.difference(b"text" * 500, one, one)


def test_vocabulary_covers_uppercase_words():
    batch = pa.array(["Some WORD", "some word"])
    first, second = toxicity._distinct_words(batch)
    assert first.tolist() == second.tolist()


def test_samples_stay_within_their_bounds(spark, monkeypatch):
    """Thousands of rows under one id: no more comes to the driver than the bounds say."""
    one = [(1, f"word{k} vilemoron same id {k % 7}", "aa") for k in range(4000)]
    docs = spark.createDataFrame(one + [(k, f"other words {k}", "zz") for k in range(2, 60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, int(k == 1)) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    anything = lambda i: F.lit(True)
    seen = {}
    monkeypatch.setattr(toxicity, "POSITIVES", 300)
    monkeypatch.setattr(toxicity, "UNLABELLED", 500)
    monkeypatch.setattr(toxicity, "train", lambda a, b, prior: seen.update(toxic=(len(a), len(b))))
    toxicity.fit(docs, labels, anything)
    assert seen["toxic"] == (300, 500)
    monkeypatch.setattr(language, "SAMPLE", 100)
    held = language.train
    monkeypatch.setattr(language, "train", lambda d, c, n: seen.update(lang=len(d)) or held(d, c, n))
    language.fit(docs, anything)
    assert 100 <= seen["lang"] <= 200
    monkeypatch.setattr(quality, "SAMPLE", 50)
    monkeypatch.setattr(quality, "PIECES", 80)
    made, fitted = quality._dictionary, quality._logistic
    monkeypatch.setattr(quality, "_dictionary", lambda p: seen.setdefault("pieces", []).append(len(p)) or made(p))
    monkeypatch.setattr(quality, "_logistic", lambda x, y: seen.update(curve=len(x)) or fitted(x, y))
    quality.fit(docs, labels, anything)
    assert max(seen["pieces"]) <= 80 and seen.get("curve", 0) <= 200


def test_long_texts_are_sampled_at_any_place(spark):
    """Pieces of a long text come from all over it."""
    text = "".join(f"{k:08d}" for k in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([text])], names=["quality", "text"])
    pieces = [p for b in quality._pieces(iter([batch])) for p in b.column("piece").to_pylist()]
    assert b"".join(pieces) == text.encode()


def test_kept_columns_must_not_clash(spark, corpus):
    docs, labels = corpus
    for name, call in (
        ("score", lambda k: toxicity.score(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.1), k)),
        ("score", lambda k: quality.score(docs, quality.Model(None, None, 0.0, 0.0), k)),
        ("lang_pred", lambda k: language.predict(docs, language.Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), 1.0), k)),
    ):
        with pytest.raises(ValueError, match=name):
            call(name)
    other = docs.drop("score").withColumn("difference", F.lit("clash"))
    model = quality.fit(docs, labels, _learn)
    assert {r.difference for r in quality.score(other, model, "doc_id", "difference").collect()} == {"clash"}


def test_gradients_and_updates_against_plain_loops():
    """FTRL-proximal with elastic net, one coordinate at a time."""
    rng = np.random.default_rng(5)
    docs = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5)) for _ in range(30)]
    classes = rng.integers(0, 3, 30)
    weights, bias = language.train(docs, classes, 3)
    z, g2 = {}, {}

    def weight(i, c):
        lasso = 0.0 if i == language.BUCKETS else language.LASSO
        v = z.get((i, c), 0.0)
        if abs(v) <= lasso:
            return 0.0
        return -(v - np.sign(v) * lasso) / ((language.BETA + np.sqrt(g2.get((i, c), 0.0))) / language.ALPHA + language.RIDGE)

    for turn in range(language.PASSES):
        for k in np.random.default_rng(turn).permutation(len(docs)):
            terms = [*zip(docs[k][0].tolist(), docs[k][1].tolist()), (language.BUCKETS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in terms for c in range(3)}
            scores = np.array([sum(x * w[i, c] for i, x in terms) for c in range(3)])
            p = np.exp(scores - scores.max())
            p /= p.sum()
            for i, x in terms:
                for c in range(3):
                    g = x * (p[c] - (classes[k] == c))
                    sigma = (np.sqrt(g2.get((i, c), 0.0) + g * g) - np.sqrt(g2.get((i, c), 0.0))) / language.ALPHA
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * w[i, c]
                    g2[i, c] = g2.get((i, c), 0.0) + g * g
    assert bias == pytest.approx([weight(language.BUCKETS, c) for c in range(3)])
    for i in range(40):
        assert weights[i] == pytest.approx([weight(i, c) for c in range(3)], abs=1e-12)


def test_block_sizes_against_plain_compression():
    good, bad = quality._compressor(b"good words here " * 60), quality._compressor(b"#$% bad ### noise " * 60)
    text = ("some good words here and ### noise " * 80).encode()
    blocks = [text[i : i + quality.BLOCK_BYTES] for i in range(0, len(text), quality.BLOCK_BYTES)]
    a, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
    assert quality.difference(text, good, bad) == (b - a) / (b + a)
