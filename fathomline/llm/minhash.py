"""Near-duplicate documents by MinHash.

Many universal hash minima of a document's shingle set are grouped into bands; documents that agree on a
band are candidates, signatures and then the full sets confirm them, and alternating star steps join the
confirmed links into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.components import components, stage_narrow
from fathomline.llm.words import map_batches, mix, shingle_hashes, word_hashes
from fathomline.sources.tables import stage

SHINGLE = 5
BANDS = 40
ROWS = 4
# Similarity in percent. A pair at 75 % is missed by all bands with a probability of (1 - 0.75^4)^40 = 2.5e-7.
THRESHOLD = 75
# Of 160 minima a pair at 75 % shares 120 on average, with a standard deviation of 5.5; five of those are allowed.
AGREEING = 92
# Members of a bucket that are compared in one go; larger buckets are cut into pieces that meet in pairs.
PIECE = 256
# Shingles of the members, and number of the asking documents, of one block of the confirming step.
PIECE_SHINGLES = 131_072
SALT_ROWS = 500
_BLOCK = 4096
_PRINTS = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, minima binary"
_SETS = "doc_id long, hi long, lo long, shingles binary"

# words are runs of bytes other than space and \t \n \v \f \r; A-Z count as a-z, a zero byte as 0xFF
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[ord("A") : ord("Z") + 1] += 32
WORD_BYTES[0] = 0xFF
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions x -> a x + b mod 2^32."""
    drawn = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
    return (drawn[::2] | np.uint32(1))[:, None], drawn[1::2][:, None].copy()


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(x), _BLOCK):
        h = a * x[None, at : at + _BLOCK]
        h += b
        m = h.min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return least


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole sorted set."""
    order = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    mixed = mix(shingles + order * np.uint64(0x9E3779B97F4A7C15))
    total, other = np.bitwise_xor.reduce(mixed), mixed.sum(dtype=np.uint64)
    return int(total.view(np.int64)), int(other.view(np.int64))


def _shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    words = word_hashes(batch.column(1), WORD_BYTES)
    for k, doc in enumerate(batch.column(0).to_pylist()):
        yield doc, np.unique(shingle_hashes(words.hashes[words.first[k] : words.first[k + 1]], SHINGLE))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _family()
    salt = mix(np.arange(BANDS, dtype=np.uint64))
    for batch in slices(batches):
        ids, sizes, his, los, bands, minima = [], [], [], [], [], []
        for doc, shingles in _shingle_sets(batch):
            ids.append(doc)
            sizes.append(len(shingles))
            if not len(shingles):
                his.append(None), los.append(None), bands.append(None), minima.append(None)
                continue
            hi, lo = _fingerprint(shingles)
            his.append(hi), los.append(lo)
            least = _minima(shingles, a, b)
            rows = least.reshape(BANDS, ROWS).astype(np.uint64)
            key = salt.copy()
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, r])
            bands.append(key.view(np.int64))
            # the low byte of each minimum is enough to estimate the share of equal ones
            minima.append(mix(least.astype(np.uint64)).astype(np.uint8).tobytes())
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()),
                pa.array(los, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(minima, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "hi", "lo", "bands", "minima"],
        )


def slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that the arrays derived from a batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(doc, *_fingerprint(s), s.tobytes()) for doc, s in _shingle_sets(batch) if len(s)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "hi", "lo", "shingles"])


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    data, bounds = text_like(column)
    return data.reshape(len(bounds) - 1, -1) if len(bounds) > 1 else np.zeros((0, BANDS * ROWS), np.uint8)


def text_like(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _similar_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        agree = (_bytes_matrix(batch.column("ma")) == _bytes_matrix(batch.column("mb"))).sum(axis=1)
        yield batch.filter(pa.array(agree >= AGREEING)).select(["a", "b"])


def _linked_with_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each asking document in a block, a link with one of the block's members if it has any.

    Rows arrive by block, members (asks = 0) first. Members are indexed by shingle, so the sizes of an
    asking set's intersections with all of them come from one look-up for each of its shingles.
    """
    block, nodes, sets, index = None, [], [], None
    for batch in batches:
        found_a, found_b = [], []
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("target", "piece", "salt"))))
        asks, names, held = batch.column("asks").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")
        for k, key in enumerate(keys):
            if key != block:
                block, nodes, sets, index = key, [], [], None
            own = np.frombuffer(held[k].as_buffer(), np.uint64)
            if not asks[k]:
                nodes.append(names[k])
                sets.append(own.copy())
                continue
            if index is None:
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                order = np.argsort(joined, kind="stable")
                index = joined[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
            shingles, owners, sizes = index
            low, high = np.searchsorted(shingles, own), np.searchsorted(shingles, own, side="right")
            count = high - low
            at = np.repeat(high - np.cumsum(count), count) + np.arange(count.sum())
            both = np.bincount(owners[at], minlength=len(sizes))
            near = np.flatnonzero(100 * both >= THRESHOLD * (len(own) + sizes - both))
            for m in near[:1]:
                found_a.append(names[k]), found_b.append(nodes[m])
        yield pa.record_batch([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, target): a document and another component with a similar signature in the same bucket.

    The node is the one of the smaller component. Rows arrive sorted by (key, one, two), so a batch ends
    inside one group at most; that group (two pieces of a bucket at most) waits for the next batch.
    """
    rest = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key = [table.column(c).to_numpy() for c in ("key", "one", "two")]
        node, comp, weight = (table.column(c).to_numpy() for c in ("node", "component", "weight"))
        size, piece = table.column("n_shingles").to_numpy(), table.column("piece").to_numpy()
        minima = _bytes_matrix(table.column("minima").combine_chunks())
        apart = key[1] != key[2]
        found: list[np.ndarray] = []
        for step in range(1, table.num_rows):
            same = np.ones(table.num_rows - step, dtype=bool)
            for k in key:
                same &= k[step:] == k[:-step]
            at = np.flatnonzero(same)
            if not len(at):
                break
            to = at + step
            # a pair inside one piece is met where that piece meets itself
            ok = (comp[at] != comp[to]) & (~apart[at] | (piece[at] != piece[to]))
            ok &= 100 * np.minimum(size[at], size[to]) >= THRESHOLD * np.maximum(size[at], size[to])
            at, to = at[ok], to[ok]
            close = (minima[at] == minima[to]).sum(axis=1) >= AGREEING
            at, to = at[close], to[close]
            swap = (weight[at] > weight[to]) | ((weight[at] == weight[to]) & (comp[at] < comp[to]))
            at, to = np.where(swap, to, at), np.where(swap, at, to)
            if len(at):
                found.append(np.unique(np.stack([node[at], comp[to]], axis=1), axis=0))
            if len(found) == 64:
                found = [np.unique(np.concatenate(found), axis=0)]
        found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.record_batch(
            [pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["node", "target"]
        )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        last = [table.column(c)[-1].as_py() for c in ("key", "one", "two")]
        same = np.ones(table.num_rows, dtype=bool)
        for c, v in zip(("key", "one", "two"), last):
            same &= table.column(c).to_numpy() == v
        cut = table.num_rows - int(same.sum())
        if cut:
            yield pairs(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _with(df: DataFrame, on: str, other: DataFrame, how: str = "inner", **columns: str) -> DataFrame:
    """``df`` with columns of ``other`` (new name = old name), matched on ``df.on = other.node``."""
    looked = other.select(F.col("node").alias("_key"), *[F.col(old).alias(new) for new, old in columns.items()])
    return df.join(looked, F.col(on) == F.col("_key"), how).drop("_key")


def _likely(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that agree in size and signature."""
    sized = _with(_with(pairs, "a", classes, na="n_shingles", ma="minima"), "b", classes, nb="n_shingles", mb="minima")
    sized = sized.where(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return sized.select("a", "b", "ma", "mb").transform(map_batches, _similar_signatures, "a long, b long")


def _confirmed(docs: DataFrame, classes: DataFrame, asking: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) found for ``asking`` (node, target) among ``members`` (target, node, n_shingles), on full sets.

    A target's members are cut into pieces of bounded total size, its asking documents into salts of
    bounded number; every piece meets every salt in a block of its own.
    """
    per_target = members.groupBy("target").agg(F.greatest(F.ceil(F.sum("n_shingles") / PIECE_SHINGLES), F.ceil(F.count("*") / PIECE)).alias("pieces"))
    asked = asking.groupBy(F.col("target").alias("_t")).agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    plan = stage_narrow(per_target.join(asked, F.col("target") == F.col("_t")).select("_t", "pieces", "salts"), "blocks")

    wanted = stage_narrow(
        members.join(plan, F.col("target") == F.col("_t"), "left_semi")
        .select("node")
        .unionByName(asking.select("node"))
        .distinct(),
        "wanted",
    )
    texts = docs.join(wanted.withColumnRenamed("node", "_want"), F.col("doc_id") == F.col("_want"), "left_semi")
    sets = texts.transform(map_batches, _sets, _SETS).groupBy("doc_id", "hi", "lo").agg(F.first("shingles").alias("shingles"))
    # a node stands for the copies of one set; rows that only share its id are not it
    own = classes.select("hi", "lo", "node").join(
        sets.withColumnsRenamed({"hi": "_hi", "lo": "_lo"}),
        (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & (F.col("node") == F.col("doc_id")),
    )
    held = stage(own.select("node", "shingles"), "sets")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def dealt(rows: DataFrame, asks: int) -> DataFrame:
        rows = rows.join(plan, F.col("target") == F.col("_t"))
        spread, fixed, most = ("piece", "salt", "salts") if asks else ("salt", "piece", "pieces")
        rows = rows.withColumn(fixed, F.pmod(F.xxhash64("node"), F.col(most))).withColumn(spread, each(f"{spread}s"))
        rows = _with(rows.select("target", "piece", "salt", "node"), "node", held, shingles="shingles")
        return rows.withColumn("asks", F.lit(asks))

    rows = dealt(members.select("target", "node"), 0).unionByName(dealt(asking, 1))
    block = ["target", "piece", "salt"]
    return (
        rows.repartition(*block).sortWithinPartitions(*block, "asks").transform(map_batches, _linked_with_members, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked when their sets of distinct five-word shingles have
    100 * intersection >= 75 * union; ``component_id`` is the smallest id in reach and ``kept`` says that
    it is the row's own. A text of fewer than five words is one shingle; a null or empty text or one of
    blanks has none, is linked with nothing and is kept. A row without an id gets no component and is
    not kept, though it does not change what others get. Copies of a row share everything; rows with one
    id and several texts count as one node of the graph in each of their classes. Other columns are
    ignored, an empty table gives an empty result.

    Copies of one set are a class that takes part once. A bucket's members are first compared with its
    smallest and its largest member, which turns groups of copies into components at the cost of two
    comparisons a member and band. Only buckets that still hold several components are compared across
    them, in pieces of bounded size, and yield documents with the components they may belong to; each such
    document is then held against all members of the component. So no candidate is left out, and what is
    shuffled stays in proportion to the documents.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    prints = stage(docs.transform(map_batches, _prints, _PRINTS), "prints")
    classes = stage(
        prints.where("hi IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("minima").alias("minima"),
        )
        .where("node IS NOT NULL"),
        "classes",
    )
    members = classes.select("node", F.explode("bands").alias("key"))
    full = stage(
        members.groupBy("key")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most"),
        "buckets",
    )
    shared = stage(
        members.join(full.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key"), "members"
    )
    with_leaders = shared.select("node", F.explode(F.array("least", "most")).alias("leader")).where("node <> leader")
    pairs = with_leaders.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
    likely = stage(_likely(classes, pairs.distinct()), "likely")
    asking = likely.select(F.col("a").alias("node"), F.col("b").alias("target"))
    leaders = likely.select(F.col("b").alias("target"), F.col("b").alias("node")).distinct()
    found = components(_confirmed(docs, classes, asking, _with(leaders, "node", classes, n_shingles="n_shingles")))

    # what is left: documents and other components that meet in a bucket
    labelled = _with(classes.select("node", "n_shingles"), "node", found, "left", target="component")
    labelled = stage_narrow(labelled.withColumn("target", F.coalesce("target", "node")), "labelled")
    asking = stage_narrow(_remaining(classes, shared, labelled), "asking")
    edges = _confirmed(docs, classes, asking, labelled)
    old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(edges.unionByName(old))

    ends = classes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.coalesce("component", "node").alias("_component")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return prints.join(ends, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left").select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
    )


def _remaining(classes: DataFrame, shared: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, target) to test: documents and unlike components inside the buckets that still hold several."""
    inside = stage_narrow(_with(shared.select("key", "node"), "node", labelled, component="target"), "inside")
    held = inside.groupBy("key", "component").agg(F.count("*").alias("n"))
    live = (
        held.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("unlike"))
        .where("unlike > 1")
        .select(
            F.col("key").alias("_key"),
            F.col("major.component").alias("major"),
            F.ceil((F.col("n") - F.col("major.n")) / PIECE).alias("minors"),
            F.ceil(F.col("major.n") / PIECE).alias("majors"),
        )
    )
    rows = inside.join(stage_narrow(live, "live"), F.col("key") == F.col("_key")).drop("_key")
    rows = _with(rows, "node", classes, n_shingles="n_shingles", minima="minima")
    weights = stage_narrow(labelled.groupBy("target").agg(F.count("*").alias("weight")), "weights")
    rows = _with(rows, "component", weights.withColumnRenamed("target", "node"), weight="weight")
    # The bucket's largest component is cut into pieces of its own, numbered after the others: they meet
    # the pieces of the rest but not each other, so a row of a large group is sent once.
    in_major = F.col("component") == F.col("major")
    piece = F.when(in_major, F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("minors"))
    )
    meets = F.when(in_major, F.col("minors")).otherwise(F.col("minors") + F.col("majors"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), meets - 1))
    rows = rows.withColumn("piece", piece).withColumn("other", other)
    rows = rows.withColumns({"one": F.least("piece", "other"), "two": F.greatest("piece", "other")})
    rows = rows.select("key", "one", "two", "piece", "node", "component", "weight", "n_shingles", "minima")
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.transform(map_batches, _bucket_pairs, "node long, target long").distinct()
