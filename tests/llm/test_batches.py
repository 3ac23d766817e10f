"""Exact duplicates across batches, phrase collocations and the filter audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import exact, filter_audit, phrases
from fathomline.llm.exact import Fuse, exact_duplicates
from fathomline.llm.words import mix

DOCS = "doc_id bigint, text string, lang string, source string"


# exact duplicates --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
def test_fuse_filter(n):
    keys = mix(np.arange(n, dtype=np.uint64))
    made = Fuse.build(keys)
    assert made.holds(keys).all()
    others = mix(np.arange(1 << 40, (1 << 40) + 50_000, dtype=np.uint64))
    assert made.holds(others).mean() < 0.008 + (n < 4)
    # the published sizes: 0.875 + 0.25 log(10^6) / log(n) cells a key, in whole segments
    assert len(made.cells) <= max(64, (1.2 if n >= 100_000 else 1.5) * n)


def _by_hand(batches):
    rows = [(i, t or "") for batch in batches for i, t in batch]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t]), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def _batches(spark, batches):
    schema = "doc_id bigint, text string, digest int, n string, batch int, kept boolean"
    return [spark.createDataFrame([(i, t, 1, "x", 9, None) for i, t in b], schema) for b in batches]


BATCHES = [
    [(1, "a"), (2, "b"), (3, "a"), (None, "b"), (4, None), (5, "")],
    [(10, "a"), (6, "c"), (7, "d"), (8, "c"), (0, "b"), (9, "ä" * 50_000), (None, "only")],
    [(20, "c"), (21, "e"), (22, "ä" * 50_000), (22, "ä" * 50_000), (11, "")],
]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """With digests that are only lengths, the bytes alone tell texts apart."""
    digest = (lambda t: F.encode(F.length(t).cast("string"), "utf-8")) if weak else exact.sha256
    got = exact_duplicates(_batches(spark, BATCHES), digest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _by_hand(BATCHES)


def test_exact_duplicates_without_rows(spark):
    assert exact_duplicates(_batches(spark, [[], []])).count() == 0
    got = exact_duplicates(_batches(spark, [[], [(1, "x"), (2, "x")]]))
    assert sorted(r.doc_id for r in got.collect() if r.kept) == [2]


def test_screen_in_parts_and_shards(spark, monkeypatch):
    """Filters of few keys, each asked in several parts: nothing that is held gets lost."""
    monkeypatch.setattr(exact, "SHARD_KEYS", 50)
    first = [(i, f"text {i}") for i in range(400)]
    second = [(1000 + i, f"text {i}") for i in range(200, 1200)]
    one, two = _batches(spark, [first, second])
    held = exact.ingest(one, [], shard_keys=50)
    assert held.shards == 8 and held.filters.count() == 8
    later = exact.ingest(two, [held], shard_keys=50)
    roots = {r.root_batch: r.n for r in later.roots.groupBy("root_batch").agg(F.count("*").alias("n")).collect()}
    assert roots == {0: 200, 1: 800}
    positives = exact.screen(later.texts, held, 1000).count()
    assert 200 <= positives < 260
    got = exact_duplicates([one, two])
    assert sorted((tuple(r) for r in got.collect()), key=str) == _by_hand([first, second])


# phrases -----------------------------------------------------------------------------------------


def _phrases_by_hand(docs, least, top):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            q[i : i + m] for q, b in frequent.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if b >= f[q[i : i + m]]
        }
        scored = []
        for p, a in frequent.items():
            if p not in inside:
                s, _, left, right = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def _prose(seed, n):
    rng = random.Random(seed)
    some = ["the", "The", "of", "cat", "DOG", "ünder", "a\x00b", "日本", "x-y", "\xa0", "run", "on", "in", "mat", "É"]
    joints = [" "] * 12 + ["\t", "  ", ", ", ". ", "\n", "\x0b", "\r\n", ";", "!"]
    weights = [1 / (k + 1) for k in range(len(some))]
    docs = []
    for i in range(n):
        words = rng.choices(some, weights, k=rng.randint(0, 80))
        text = "".join(w + rng.choice(joints) for w in words)
        docs.append((i, text, rng.choice(["en", "en", "de", None]), "s"))
    passage = "a passage of more than five words that many texts share"
    docs += [(n + i, f"{passage}. {passage}", "en", "s") for i in range(30)]
    return docs + [(-1, None, "en", "s"), (-2, "", None, "s"), (-3, " \t., ", "de", "s"), (-4, "one two " * 3000, "fr", "s")]


@pytest.mark.parametrize("budget", [1 << 20, 4000, 64])
def test_collocations(spark, monkeypatch, budget):
    """Also with budgets that extend prefixes up to whole phrases, and blocks that cut texts."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 1000)
    docs = _prose(budget, 120)
    frame = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit(1), "hash": F.lit("x")}).repartition(3)
    got = phrases.collocations(frame, least=8, top=60, group_suffixes=budget)
    want = _phrases_by_hand(docs, 8, 60)
    assert len(want) > 40
    assert sorted(tuple(r) for r in got.collect()) == want


def test_collocations_without_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None), (2, "rare words", "en", "s")], DOCS)).collect() == []


def test_scores_are_exact(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        n = rng.randint(10**9, 10**14)
        left, right = rng.randint(100, n), rng.randint(100, n)
        rows.append((rng.randint(100, min(left, right)), n, left, right))
    rows.append((3, 7, 1, 21000))
    frame = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    got = frame.select("a", "n", "l", "r", phrases._score(*map(F.col, ("a", "n", "l", "r"))).alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_other_seeds_keep_separators():
    for seed in range(1, 4):
        table = phrases._byte_table(seed)
        assert ((table == 0) == (phrases._WORD == 0)).all()
        assert len(np.unique(table)) == len(np.unique(phrases._WORD))
        assert (table[ord("A") : ord("Z") + 1] == table[ord("a") : ord("z") + 1]).all()


# filter audit ------------------------------------------------------------------------------------


def _audit_by_hand(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    # a label without doc_id is no label of a document without one
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, _, source in docs:
        text = text or ""
        w = re.findall("[^ \t-\r]+", text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        parts[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, orders = [], ["".join(o) for o in permutations("ABCDE")]
    for part, rows in parts.items():
        removed = {(o, s): [r for r in rows if o[s] in r[0] and not r[0] & set(o[:s])] for o in orders for s in range(5)}
        shapley = {f: sum(len(removed[o, o.index(f)]) for o in orders) for f in "ABCDE"}
        for (o, s), gone in removed.items():
            failing = sum(o[s] in r[0] for r in rows)
            kept = sum(not r[0] & set(o[: s + 1]) for r in rows)
            unique = sum(r[0] == {o[s]} for r in rows)
            out.append(
                (part, o, s + 1, kept, len(gone), failing - len(gone), unique, sum(r[1] for r in gone), sum(r[2] for r in gone), shapley[o[s]])
            )
    return sorted(out)


def _audited(docs, labels):
    rows = filter_audit.with_labels(filter_audit.failed_filters(docs), labels)
    return sorted(tuple(r) for r in filter_audit.audit(rows, filter_audit.FILTERS).collect())


def test_filter_audit(spark):
    rng = random.Random(1)
    docs = []
    for i in range(150):
        vocabulary = [f"w{k}" for k in range(rng.choice([20, 400]))]
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 150, 199, 200, 201, 250]))
        text = rng.choice([" ", "\t", "\n\x0b", "\xa0 "]).join(words) + rng.choice(["", "", "#", " é", " ABCDEFGH", "Z" * 30])
        docs.append((i, text, "en", rng.choice(["a", "a", "b", None])))
    docs += [(1000 + i, docs[rng.randrange(150)][1], "en", rng.choice(["a", "b", ""])) for i in range(60)]
    docs += [(7, docs[7][1], "en", "a"), (1001, docs[7][1], "en", "b"), (None, docs[7][1], "en", "a"), (None, None, None, None), (3000, None, None, "c"), (3001, "", None, "c")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in rng.sample(range(1050), 400)] + [(7, 1, 0), (7, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit(1), "A": F.lit("x"), "good": F.lit(True)}).repartition(4)
    assert _audited(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")) == _audit_by_hand(docs, labels)


def test_filter_audit_without_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert _audited(spark.createDataFrame([], DOCS), labels) == []
    got = _audited(spark.createDataFrame([(1, "x", None, None)], DOCS), labels)
    assert len(got) == 600 and {g[0] for g in got} == {""}


def test_contractions_of_other_sizes():
    """Any number of filters: against sums over the cells one by one."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 4):
        tensor = rng.integers(0, 50, (2, *[2] * n))
        _, choices = filter_audit.selections(n)
        for choice in choices.values():
            got = filter_audit.contract(tensor, choice)
            for row, figures in zip(choice, got):
                cells = [c for c in np.ndindex(*[2] * n) if all(row[a][c[a]] for a in range(n))]
                assert [sum(tensor[(m, *c)] for c in cells) for m in range(2)] == list(figures)
