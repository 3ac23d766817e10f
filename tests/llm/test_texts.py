"""Tokens, personal data, benchmark passages, chats and archives against brute force."""

import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fathomline.llm import bpe, chat, decontamination, pii, queries, warc


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        return bpe.Codec(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


def test_tree_gives_the_tokens_of_the_library(codec, monkeypatch):
    rng = random.Random(1)
    alphabet = "abc 's\n\t'reé日本ß12 .,!—'   _-　x'LĹ\x1c\x85\U0001f600"
    monkeypatch.setattr(bpe, "LEAF", 5)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids.tolist() == codec._leaf.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 70_000, " " * 70_000, "\n " * 40_000 + "x", "12" * 40_000, "日" * 30_000])
def test_long_runs(codec, text):
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    if len(text) <= 40_000:
        assert ids.tolist() == codec._leaf.encode_ordinary(text)


def test_encode_decode_rows(spark):
    ranks = queries.ranks(spark)
    rows = [(1, None), (2, ""), (3, "The word. " * 3000), (None, "x"), (3, "again"), (4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    tokens = bpe.encode(df, ranks, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    reference = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks.value), special_tokens={}
    )
    for r in tokens.collect():
        if r.doc_id == 4:
            assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary("<|endoftext|>")
    assert bpe.round_trip(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for order, (kind, expression) in enumerate(PLAIN.items()):
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and pii._luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


@pytest.mark.parametrize("alphabet", ["a@.1 -+()", "12345. -", "a.@-", "+0123 4().-", "@a1.+ -é"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == _plain_spans(text), text


def test_luhn_and_long_runs():
    assert pii._luhn("4111111111111111") and not pii._luhn("4111111111111112")
    for text in ("1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "a@a." * 25_000, "'" + "a" * 100_000):
        assert len(pii.base_spans(text)) < 50_000
        pii.candidates(text, [])


def test_classifier_adds_secrets_and_keeps_base(spark):
    token = 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"'
    rows = [(k, f"words {token} more user{k}@mail.example.com") for k in range(30)]
    rows += [(100, None), (101, ""), (102, "version 'aaaaaaaaaaaaaaaaaaaaaaaa' of the licence"), (None, "call +1 (314) 555-6532")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    model = pii.fit(df)
    assert all(0 < right < 1 for right, _ in model.reliability.values())
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    assert [s.kind for s in got[3].spans] == ["secret", "email"] and [s.kind for s in got[3].base] == ["email"]
    assert got[100].spans == got[101].spans == got[102].spans == []
    assert [s.kind for s in got[None].base] == ["phone"]
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert clean[3] == 'words token = "[SECRET]" more [EMAIL]' and clean[100] is None
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


def _distance(item, text):
    """Least edits between item and a stretch of text, cell by cell."""
    above = [0] * (len(text) + 1)
    for row, word in enumerate(item, 1):
        line = [row]
        for k, other in enumerate(text):
            line.append(min(above[k] + (word != other), above[k + 1] + 1, line[k] + 1))
        above = line
    return min(above)


def test_edit_distance_and_its_stretch():
    rng = np.random.default_rng(4)
    for _ in range(300):
        item = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64)
        edits, begin, end = decontamination.edit_distance(item, text)
        assert edits == _distance(item.tolist(), text.tolist())
        assert 0 <= begin <= end <= len(text) and _distance(item.tolist(), text[begin:end].tolist()) == edits


def test_passages_with_edits_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 70)))) for k in range(60)]
    docs, truth = [], set()
    for k, text in items:
        own = text.split()
        for _ in range(int(0.2 * len(own))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        filler = [rng.choice(vocabulary) for _ in range(150)]
        at = rng.randrange(150)
        docs.append((k, " ".join(filler[:at]) + "!! " + ", ".join(own).upper() + " " + " ".join(filler[at:])))
        truth.add((k, k))
        docs.append((1000 + k, " ".join(rng.choice(vocabulary) for _ in range(300))))
    docs += [(2000, None), (2001, ""), (None, items[0][1]), (5000, items[1][1]), (5000, items[1][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (None, "x")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = [(r.doc_id, r.item_id) for r in decontamination.passages(df, bench).collect()]
    assert len(got) == len(set(got)) + 1  # the repeated row
    found = set(got) - {(None, 0), (5000, 1)}
    assert found <= truth and len(found) >= 0.98 * len(truth)
    assert {(None, 0), (5000, 1)} <= set(got)
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {a for a, _ in got}
    assert decontamination.passages(df.limit(0), bench).count() == 0
    assert decontamination.passages(df, bench.limit(0)).count() == 0


def _found(docs, items):
    prepared = decontamination.prepare(list(range(len(items))), items)
    return {k: v[0] for k, v in decontamination.find(pa.array([d.lower() for d in docs], pa.string()), prepared).items()}


def test_words_are_unicode_letters_and_digits():
    texts = [
        "don\u2019t\u00a0stop \u2014 \u201cnow\u201d\u3002", "don't stop - now.", "日本語は、ok2 カー", "ภาษาไทย ๑๒", "cafe\u0301 \u2764\ufe0f \u0301x",
        "\u0301", None, "\U00020000\U00020001 हिन्दी ñé", "é", "é",
    ]
    split = decontamination.split_words(pa.array(texts, pa.string()), decontamination.character_classes())
    words = [bytes(split.data[a:b]).decode() for a, b in zip(split.starts, split.ends)]
    own = [words[a:b] for a, b in zip(split.first[:-1], split.first[1:])]
    assert own == [
        ["don", "t", "stop", "now"], ["don", "t", "stop", "now"], ["日", "本", "語", "は", "ok2", "カ", "ー"],
        ["ภ", "า", "ษ", "า", "ไ", "ท", "ย", "๑๒"], ["cafe\u0301", "x"], [], [], ["\U00020000", "\U00020001", "हिन्दी", "ñé"], ["é"], ["é"],
    ]
    assert split.hashes[:4].tolist() == split.hashes[4:8].tolist()


def test_short_items_and_unspaced_scripts_are_found():
    short = ["alpha", "alpha beta", "one two three", "a b c d", "k1 k2 k3 k4 k5 k6 k7 k8 k9"]
    got = _found(["x " + t + " y" for t in short] + ["one two", "three", "a b d", "a q b c d", "k1 q k3 k4 k5 k6 q k8 k9"], short)
    assert {(k, k): 0 for k in range(5)}.items() <= got.items()
    assert set(got) == {(k, k) for k in range(5)} | {(1, 0), (7, 3), (8, 3), (9, 4)}
    assert (got[7, 3], got[8, 3], got[9, 4]) == (1, 1, 2)
    chinese = "床前明月光疑是地上霜举头望明月低头思故乡"
    assert _found(["古诗：" + chinese[:10] + "，" + chinese[10:] + "。", "古诗"], [chinese]) == {(0, 0): 0}
    quoted = "He said that every one of them would be there at noon or so"
    glued = "he\u00a0said\u2014\u201cthat every\u201d one\u2019of\u00a0them would\u2014be there\u00a0at\u2014noon or\u00a0so"
    assert _found([glued], [quoted]) == {(0, 0): 0}


def test_short_items_equal_brute_force():
    rng = random.Random(4)
    items = list(dict.fromkeys(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(150)))
    docs = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            edits = _distance(item.split(), doc.split())
            if edits <= len(item.split()) // 4:
                want[d, i] = edits
    assert _found(docs, items) == want


@pytest.mark.parametrize("length", [4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 16, 20, 31, 32, 40, 64])
@pytest.mark.parametrize("kinds", ["s", "sdi"])
def test_recall_at_a_quarter_of_edits(length, kinds):
    rng = random.Random(length)
    vocabulary = [f"word{k}" for k in range(20_000)]
    items = [[rng.choice(vocabulary) for _ in range(length)] for _ in range(300)]
    docs = []
    for item in items:
        own = list(item)
        for _ in range(length // 4):
            kind, at = rng.choice(kinds), rng.randrange(len(own))
            own[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(vocabulary)]
        filler = [rng.choice(vocabulary) for _ in range(40)]
        cut = rng.randrange(41)
        docs.append(" ".join(filler[:cut] + own + filler[cut:]))
    got = _found(docs, [" ".join(item) for item in items])
    found = sum((k, k) in got for k in range(300))
    assert found >= 297
    if 10 <= length < 32:
        assert found == 300


def test_blocks_and_parts_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = list(dict.fromkeys(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))) for _ in range(80)))
    docs = ["", "a"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    prepared = decontamination.prepare(list(range(len(items))), items)
    whole = decontamination.find(pa.array(docs, pa.string()), prepared)
    monkeypatch.setattr(decontamination, "COLLISIONS", 50)
    monkeypatch.setattr(decontamination, "CELLS", 200)
    assert decontamination.find(pa.array(docs, pa.string()), prepared) == whole
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 600)
    assert len(decontamination.benchmark_items(bench)) > 1
    got = decontamination.passages(df, bench).collect()
    assert {(r.doc_id, r.item_id): (r.edits, r.first_word, r.end_word) for r in got} == whole and len(got) == len(whole)
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == set(range(len(docs))) - {d for d, _ in whole}


def test_chat_round_trip_and_escapes(spark):
    rng = random.Random(0)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "ok", " [/INST]", "\n", "é", "<<SYS>>", "<</SYS>>", "$1"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "sys [/INST]x", None]),
         None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))))
        for c in range(40) for t in range(rng.randint(1, 5))
    ]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("log", F.lit(1))
    plan = chat.parse(chat.render(chat.fold(chat.events_of_turns(df))))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
    for r in plan.collect():
        own = sorted((t or 0, a or "", x or "") for c, t, a, x in rows if c == r.conv_id)
        assert [(m.role, m.text) for m in r.messages] == [(a, x) for _, a, x in own]
        assert r.loss_texts == [x for _, a, x in own if a == "assistant"]
        assert r.formatted.count("</s>") == r.formatted.count("[/INST]") == len(own)
    assert chat.parse(chat.render(chat.fold(chat.events_of_turns(df.limit(0))))).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "message", "user"), (1, 2, 0, "delta", "a"), (1, 3, 0, "delta", "b"), (1, 4, 0, "message", "assistant"),
        (1, 5, 0, "delta", "x"), (1, 6, 0, "regenerate", None), (1, 7, 0, "delta", "y"), (1, 8, 0, "edit", "z"),
        (1, 9, 0, "delta", "!"), (2, 1, 0, "delta", "q"), (3, 1, 0, "message", None), (3, 2, 0, "other", "?"),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, step int, kind string, value string")).collect()
    found = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in got}
    assert found == {1: [("user", "ab"), ("assistant", "z!")], 2: [], 3: [("", "")]}


def test_archives_give_back_every_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    long = "<p>" + "x" * 200
    rows = [(k, f"http://h{k % 5}.example.com:80/a?b={k}", long + str(k % 7)) for k in range(40)]
    rows += [(50, None, None), (51, "no url\r\nat all", ""), (52, "http://u@H.example.org/ x", "short"), (53, rows[0][1], "short")]
    rows += [(60, rows[0][1], "z" * 50_000), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    archives = warc.write(df, f"file://{tmp_path}/warc")
    assert archives.count() > 2
    got = [tuple(r)[:5] for r in warc.look_up(archives, df).collect()]
    first = {}
    for k, _, html in rows:
        if len(html or "") >= 100:
            first[html] = min(k, first.get(html, k))
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        revisit = first.get(html, k) != k
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.look_up(archives, spark.createDataFrame([(7, "http://nowhere.example/")], "page_id long, url string")).count() == 0
    assert warc.look_up(warc.write(df.limit(0), f"file://{tmp_path}/none"), df).count() == 0


def test_record_is_a_gzip_member_with_warc_headers():
    data = gzip.compress(warc._record(5, "http://x/", "response", "d", None, 3, b"a\r\n"))
    headers, size, payload = warc.read_record(data)
    assert (headers["WARC-Type"], headers["WARC-Target-URI"], size, payload) == ("response", "http://x/", 3, b"a\r\n")


def test_words_do_not_run_over_texts():
    from fathomline.llm.words import word_hashes

    split = word_hashes(pa.array(["ab", "ab", None, " ab  c", ""]), decontamination.WORD_BYTES)
    assert np.diff(split.first).tolist() == [1, 1, 0, 2, 0]
    assert split.hashes[0] == split.hashes[1] == split.hashes[2] != split.hashes[3]
