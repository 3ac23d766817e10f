"""Near-duplicates of texts and vectors against brute force, with the edge cases of the docstrings."""

import random

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import embeddings, minhash
from fathomline.llm.components import components


def _shingles(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] if word else []
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def _reach(ids, linked):
    least = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two"), (6, "É x"), (7, "é x")]
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120]))]
        for copy in range(12):
            own = list(words)
            for _ in range(copy // 2):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((100 * base + 10 + copy, " ".join(own)))
    rows.append((900, "x" * 50_000 + " " + " ".join(vocabulary * 40)))
    df = spark.createDataFrame(rows + [(None, "one two"), (20, dict(rows)[10])], "doc_id long, text string")
    df = df.withColumns({"node": F.lit(1), "component": F.lit("x"), "hi": F.lit(None).cast("string")})
    got = minhash.near_duplicates(df).collect()
    sets = {i: _shingles(t) for i, t in rows}
    sets[20] = sets[20]
    ids = [i for i, _ in rows]
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    least = _reach(ids, linked)
    assert len(got) == len(rows) + 2
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and not row.kept and row.n_shingles == 1
        elif row.doc_id != 20:
            assert row.n_shingles == len(sets[row.doc_id])
            assert row.component_id == least[row.doc_id], row
            assert row.kept == (row.component_id == row.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_of_large_buckets(spark, monkeypatch):
    """The same components when every bucket is cut into many pieces."""
    monkeypatch.setattr(minhash, "PIECE", 4)
    monkeypatch.setattr(minhash, "SALT_ROWS", 3)
    monkeypatch.setattr(minhash, "PIECE_SHINGLES", 50)
    rng = random.Random(2)
    words = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(60):  # copies of one text, each with its own change, and of two thirds of it
        own = list(words if k % 3 else words[:42])
        own[rng.randrange(len(own))] = f"c{k}"
        rows.append((k, " ".join(own)))
    sets = {i: _shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = _reach(list(sets), linked)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == least


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.component for r in got.collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for center in rng.normal(size=(6, 24)):
            for k in range(8):
                rows.append((center + rng.normal(scale=0.06 * k, size=24), label))
    rows += [(rows[0][0], 0), (rows[0][0] * 3, 0), (rows[0][0], 1)]  # a copy, a multiple, and the same under another label
    table = [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(rows)]
    n = len(table)
    odd = [
        (n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, table[0][1], None),
        (n + 4, [float("inf")] + [1.0] * 23, 0), (n + 5, [None] + [1.0] * 23, 0), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0),
    ]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    unit = np.array([v / np.linalg.norm(v) for v, _ in rows])
    near = (unit @ unit.T >= 0.93) & np.array([[a[1] == b[1] for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    least = _reach(range(n), [(a, b) for a in range(n) for b in range(a) if near[a, b]])
    assert len(got) == n + len(odd)
    for k in range(n):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum(), least[k], least[k] == k)
    for k in range(n, n + len(odd)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """One table finds a pair at cosine 0.93 more often than 0.7, so ten miss fewer than one in 10^5."""
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    home_x, guest_x = embeddings.codes(x)
    home_y, guest_y = embeddings.codes(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    met = (home_x == home_y) | (guest_x == home_y[:, :, None]).any(2) | (guest_y == home_x[:, :, None]).any(2)
    assert met.mean() > 0.7 and met.any(axis=1).all()
