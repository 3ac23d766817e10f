"""The corpus pipeline on a small folder of tables, stage by stage against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import bpe, queries
from tests.llm.test_pairs import _shingles

BAD = ("vilemoron", "grimscum", "foultrash")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        own = [rng.choice(words) for _ in range(60)]
        if k % 6 == 0:
            for bad in BAD:
                own.insert(rng.randrange(len(own)), bad)
        if k % 20 == 1:
            own[20:20] = items[k % 5][1].split()
        if k % 20 == 3:
            own += ["mail", f"user{k}@mail.example.com", "now"]
        docs.append((k, " ".join(own), "en", "src", 0))
        labels.append((k, 1, int(k % 6 == 0)))
    docs += [(400 + k, docs[k][1], "en", "src", 0) for k in (7, 8, 9)]  # copies
    docs += [(500 + k, docs[k][1] + " more", "en", "src", 0) for k in (7, 8)]  # near copies
    docs += [(600, None, None, None, None), (601, "", "en", None, 0), (7, docs[7][1], "en", "src", 0), (None, "no id here", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {k: t for k, t, *_ in docs if k is not None}, items


def test_stages_and_result(spark, folder):
    path, texts, items = folder
    toxic = {k for k, t in texts.items() if any(b in (t or "") for b in BAD)}
    leaks = {k for k, t in texts.items() if any(i in (t or "") for _, i in items)}
    copies = {407, 408, 409, 507, 508}
    for a in (7, 8):
        x, y = _shingles(texts[a]), _shingles(texts[500 + a])
        assert 100 * len(x & y) >= 75 * len(x | y)
    got = corpus_pipeline.run(spark, path).collect()
    ids = [r.doc_id for r in got]
    want = set(texts) - toxic - leaks - copies
    assert sorted(i for i in ids if i is not None) == sorted(want)  # each once, the repeated row too
    assert ids.count(None) == 1
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        codec = bpe.Codec(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        decoded = codec.decode(ids)
        assert len(ids) == r.n_tokens and hashlib.sha256(decoded).hexdigest() == r.decoded_sha256
        text = texts.get(r.doc_id) if r.doc_id is not None else "no id here"
        if r.doc_id is not None and r.doc_id % 20 == 3 and r.doc_id < 300:
            text = text.replace(f"user{r.doc_id}@mail.example.com", "[EMAIL]")
        assert decoded.decode() == (text or "")


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"score": F.lit(1), "row": F.lit("x"), "node": F.lit(2)})
    for _, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, docs.limit(0), path)
        assert out.dtypes == docs.dtypes and out.count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [
        (1, "one text of its own words here", "a"), (1, "quite another text with nothing shared", "b"),
        (2, long, "c"), (2, long + " more", "d"), (2, long, "e"), (3, long, "f"), (4, None, "g"), (4, "", "h"), (4, "some text", "i"),
        (5, "quite another text with nothing shared", "j"), (None, long, "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert [g for g in got if g[0] == 1 or g[0] == 5].count((1, rows[0][1])) == 1
    assert sum(t == rows[1][1] for _, t in got) == 1  # linked with the text of id 5: one of them stays
    assert sum(t.startswith(long) and k > 0 for k, t in got) == 1
    assert [t for k, t in got if k == 4] == ["", "some text"]
    assert (-1, long) in got and len(got) == 6
