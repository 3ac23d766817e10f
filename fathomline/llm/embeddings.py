"""Near-duplicate vectors by cross-polytope hashing with multiprobe.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its cross-polytope
hash is the axis it lies closest to, with the sign. Two such hashes make a bucket of a table. A vector is at
home in its own bucket and a guest in the next likely ones; pairs of which one is at home are verified by
their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.components import components
from fathomline.llm.minhash import _with, slices
from fathomline.llm.words import map_batches, mix
from fathomline.sources.tables import stage

THRESHOLD = 0.93
# At 64 dimensions a pair at the threshold meets in one table with a probability of 0.74 (measured), so it
# is missed by all with 0.26^10 = 1.4e-6.
TABLES = 10
GUESTS = 4
PIECE = 128
_PAIRS = 8192
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of unit vectors: (n, TABLES) of their homes and (n, TABLES, GUESTS) as guests."""
    n, dims = vectors.shape
    width = max(4, 1 << (dims - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dims] = vectors
    home, guest = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES, GUESTS), np.int64)
    ranks = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 1))
    for table in range(TABLES):
        axes, loss = [], []
        for part in range(2):
            signs = np.random.default_rng([table, part, width]).choice([-1.0, 1.0], size=(3, width))
            turned = padded
            for round_signs in signs:
                turned = _hadamard(turned * round_signs) / np.sqrt(width)
            size = np.abs(turned)
            best = np.empty((n, 3), np.int64)
            near = np.empty((n, 3))
            for rank in range(3):
                best[:, rank] = size.argmax(axis=1)
                near[:, rank] = size[np.arange(n), best[:, rank]]
                size[np.arange(n), best[:, rank]] = -1
            axes.append(2 * best + (np.take_along_axis(turned, best, axis=1) < 0))
            loss.append(near[:, :1] - near)
        home[:, table] = axes[0][:, 0] * 2 * width + axes[1][:, 0]
        cost = np.stack([loss[0][:, a] + loss[1][:, b] for a, b in ranks], axis=1)
        other = np.stack([axes[0][:, a] * 2 * width + axes[1][:, b] for a, b in ranks], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :GUESTS]
        guest[:, table] = np.take_along_axis(other, order, axis=1)
    return home, guest


def _unit(vectors: np.ndarray) -> np.ndarray:
    # the largest component first, so that neither tiny nor huge ones leave the range of doubles
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles, with a 128-bit fingerprint; others with nulls."""
    for batch in slices(batches, 1024):
        his, los, raw = [], [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
            values = vector.values if vector.is_valid else None
            usable = label is not None and values is not None and len(values) and not values.null_count
            x = values.to_numpy(zero_copy_only=False).astype(np.float64) if usable else None
            if x is None or not np.isfinite(x).all() or not x.any():
                his.append(None), los.append(None), raw.append(None)
                continue
            x = x + 0.0  # one zero only
            mixed = mix(x.view(np.uint64) + np.arange(1, len(x) + 1, dtype=np.uint64) * _GOLDEN)
            his.append(int(np.bitwise_xor.reduce(mixed).view(np.int64)))
            los.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
            raw.append(x.tobytes())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(raw, pa.binary())],
            names=["vec_id", "label", "hi", "lo", "vector"],
        )


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each dimension that occurs."""
    raw = [x.as_buffer() for x in column]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(np.stack([np.frombuffer(raw[r], np.float64) for r in rows]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the keys of its buckets (of each table its home, then as a guest) and their numbers."""
    for batch in slices(batches, 1024):
        label = batch.column("label").to_numpy().astype(np.int64)
        for rows, unit in _by_width(batch.column("vector")):
            home, guest = codes(unit)
            numbers = np.concatenate([home[:, :, None], guest], axis=2)
            key = mix(np.full(len(rows), np.uint64(unit.shape[1])) * _GOLDEN ^ label[rows].view(np.uint64))
            key = mix(key[:, None] * _GOLDEN ^ np.arange(TABLES, dtype=np.uint64)[None, :])
            key = mix(key[:, :, None] * _GOLDEN ^ numbers.astype(np.uint64)).view(np.int64)
            flat = pa.array(key.ravel())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TABLES * (1 + GUESTS))
            kept = batch.take(pa.array(rows))
            yield pa.record_batch(
                [
                    *kept.columns,
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array([x.astype(np.int64).tobytes() for x in numbers], pa.binary()),
                ],
                names=[*batch.schema.names, "keys", "numbers"],
            )


def _counted_here(a: np.ndarray, b: np.ndarray, table: np.ndarray, a_home: np.ndarray) -> np.ndarray:
    """Whether this bucket is the first in which the pair meets; ``a`` holds the numbers of the smaller id."""
    home_a, home_b = a[:, :, 0], b[:, :, 0]
    b_visits = (b[:, :, 1:] == home_a[:, :, None]).any(axis=2)
    a_visits = (a[:, :, 1:] == home_b[:, :, None]).any(axis=2)
    same = home_a == home_b
    first = (same | b_visits | a_visits).argmax(axis=1) == table
    row = np.arange(len(table))
    # in one table they may meet in either home; the home of the smaller id comes first
    return first & (same[row, table] | a_home | ~b_visits[row, table])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, root) per vector of a block with links: copies linked first here, and a node it is joined with."""
    rest = None

    def links(table: pa.Table) -> pa.RecordBatch:
        key = [table.column(c).to_numpy() for c in ("key", "one", "two", "label")]
        node, copies, home, piece, number = (
            table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "home", "piece", "hash")
        )
        raw = [x.as_buffer() for x in table.column("vector").combine_chunks()]
        sizes = np.array([len(x) for x in raw])
        left, right = [], []
        vectors = np.zeros((len(raw), int(sizes.max()) // 8 if len(raw) else 0))
        for rows, own in _by_width(table.column("vector").combine_chunks()):
            vectors[rows, : own.shape[1]] = own
        for step in range(1, table.num_rows):
            same = np.ones(table.num_rows - step, dtype=bool)
            for k in key[:3]:
                same &= k[step:] == k[:-step]
            at = np.flatnonzero(same)
            if not len(at):
                break
            to = at + step
            ok = (home[at] | home[to]) & (key[3][at] == key[3][to]) & (sizes[at] == sizes[to])
            ok &= (key[1][at] == key[2][at]) | (piece[at] != piece[to])
            at, to = at[ok], to[ok]
            for k in range(0, len(at), _PAIRS):
                a, b = at[k : k + _PAIRS], to[k : k + _PAIRS]
                near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= THRESHOLD
                left.append(a[near]), right.append(b[near])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
        n = np.zeros(table.num_rows, np.int64)
        root = np.arange(table.num_rows)
        held = np.frombuffer(b"".join(table.column("numbers").to_pylist()), np.int64).reshape(-1, TABLES, 1 + GUESTS)
        for k in range(0, len(a), _PAIRS):
            x, y = a[k : k + _PAIRS], b[k : k + _PAIRS]
            here = _counted_here(held[x], held[y], number[x], home[x])
            np.add.at(n, x[here], copies[y[here]])
            np.add.at(n, y[here], copies[x[here]])
        while len(a):  # the smallest row in reach inside the table
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        used = np.unique(np.concatenate([a, b])).astype(np.int64)
        return pa.record_batch(
            [pa.array(node[used]), pa.array(n[used]), pa.array(node[root[used]])], names=["node", "n", "root"]
        )

    names = ("key", "one", "two")
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, dtype=bool)
        for c in names:
            values = table.column(c).to_numpy()
            same &= values == values[-1]
        cut = table.num_rows - int(same.sum())
        if cut:
            yield links(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield links(rest)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label and dimension are linked when their cosine is at least 0.93. A null label,
    a null, empty or zero vector and one with a null, NaN or infinite component link with nothing.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest
    vec_id in reach. A row without vec_id counts as a partner but gets no component and is not kept.
    Other columns are ignored; an empty table gives an empty result.

    Copies of a vector take part once, with their number. Buckets are cut into pieces that meet in pairs;
    each block sends on one row for each of its vectors, whatever the number of links, and counts a link
    only in the first bucket in which the pair meets.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    prepared = stage(rows.transform(map_batches, _prepared, "vec_id long, label long, hi long, lo long, vector binary"), "vectors")
    classes = (
        prepared.where("hi IS NOT NULL")
        .groupBy("label", "hi", "lo")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        # a class without any id still has partners: a number of its own stands for it
        .withColumn("node", F.coalesce("least", F.xxhash64("label", "hi", "lo")))
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    classes = stage(classes.transform(map_batches, _buckets, f"{kept}, keys array<long>, numbers binary"), "classes")
    spots = classes.select("node", F.posexplode("keys").alias("place", "key")).select(
        "node", "key",
        (F.col("place") % (1 + GUESTS) == 0).alias("home"),
        F.floor(F.col("place") / (1 + GUESTS)).cast("long").alias("hash"),
    )
    homes = F.count(F.when(F.col("home"), 1))
    live = stage(
        spots.groupBy("key")
        .agg(homes.alias("homes"), F.count("*").alias("all"))
        .where("homes > 0 AND all > 1")
        .select(
            F.col("key").alias("_key"),
            F.ceil(F.col("homes") / PIECE).alias("at_home"),
            F.ceil((F.col("all") - F.col("homes")) / PIECE).alias("visiting"),
        ),
        "live",
    )
    dealt = spots.join(live, F.col("key") == F.col("_key")).drop("_key")
    number = F.xxhash64("node")
    piece = F.when(F.col("home"), F.pmod(number, F.col("at_home"))).otherwise(
        F.col("at_home") + F.pmod(number, F.col("visiting"))
    )
    meets = F.when(F.col("home"), F.col("at_home") + F.col("visiting")).otherwise(F.col("at_home"))
    dealt = dealt.withColumn("piece", piece).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1))
    )
    dealt = dealt.withColumns({"one": F.least("piece", "other"), "two": F.greatest("piece", "other")})
    dealt = _with(
        dealt.select("key", "one", "two", "piece", "node", "home", "hash"), "node", classes,
        label="label", copies="copies", vector="vector", numbers="numbers",
    )
    found = stage(
        dealt.repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
        .transform(map_batches, _linked, "node long, n long, root long"),
        "links",
    )
    counts = stage(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = _with(_with(classes, "node", counts, "left", n="n"), "node", joined, "left", component="component")
    named = named.withColumn("component", F.coalesce("component", "node"))
    # nodes that stand for classes without an id are no component ids: take the least id there is
    least = stage(named.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    named = _with(named, "component", least.withColumnRenamed("component", "node"), smallest="smallest")
    ends = named.select(
        F.col("label").alias("_label"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.col("smallest").alias("_component"),
    )
    same = (F.col("label") == F.col("_label")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("_component", "vec_id"))
    return prepared.join(ends, same, "left").select(
        "vec_id",
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
