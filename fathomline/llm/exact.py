"""Exact duplicates across batches: static filters per snapshot, exact buckets, byte checks.

A batch becomes classes of equal texts (grouped by digest and text, so equality is byte by byte). An earlier
batch is an immutable snapshot: its new classes, and a static 3-wise binary-fuse filter for each shard of
their digests. Digests of a later batch are screened by those filters; only positives meet the exact buckets
of the snapshot and have their bytes compared. What no snapshot holds is new and forms the next snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.words import mix
from fathomline.sources.tables import stage

# Keys of one filter: a shard of the snapshot, built and asked in one task (about 1.1 bytes a key).
SHARD_KEYS = 1 << 18
FINGERPRINT = np.uint64(0xFF)
_ATTEMPTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Fuse:
    """A 3-wise binary-fuse filter over 64-bit keys with fingerprints of 8 bits.

    Every key asked for at construction is found; another one with a chance of 1 in 256.
    """

    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    @staticmethod
    def sizes(n: int) -> tuple[int, int]:
        """Length and number of the segments in which the first cell of a key may lie."""
        if n < 2:
            return 4, 1
        segment = min(1 << floor(log(n) / log(3.33) + 2.25), 1 << 18)
        capacity = n * max(1.125, 0.875 + 0.25 * log(1e6) / log(n))
        return segment, max(1, ceil(capacity / segment) - 2)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells of each key, in three adjoining segments, and its fingerprint."""
        h = mix(keys ^ mix(np.full(1, self.seed + 1, dtype=np.uint64)))
        span, mask = np.uint64(self.segment * self.segments), np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        step = np.uint64(self.segment)
        second = (first + step) ^ ((h >> np.uint64(18)) & mask)
        third = (first + step + step) ^ (h & mask)
        print_ = (h ^ (h >> np.uint64(32))) & FINGERPRINT
        return np.stack([first, second, third], axis=1).astype(np.int64), print_.astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        """A filter of distinct keys. Keys with a cell of their own are peeled off, all of them at a time,
        until none is left; cells are filled in the opposite order. A seed that leaves a core is replaced."""
        segment, segments = cls.sizes(len(keys))
        for seed in range(_ATTEMPTS):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, dtype=np.uint8))
            at, prints = made.places(keys)
            held = np.bincount(at.ravel(), minlength=len(made.cells))
            who = np.zeros(len(made.cells), dtype=np.int64)
            np.bitwise_xor.at(who, at.ravel(), np.repeat(np.arange(len(keys)), 3))
            rounds, alone = [], np.flatnonzero(held == 1)
            while len(alone):
                peeled, which = np.unique(who[alone], return_index=True)
                rounds.append((peeled, alone[which]))
                cells = at[peeled].ravel()
                np.subtract.at(held, cells, 1)
                np.bitwise_xor.at(who, cells, np.repeat(peeled, 3))
                touched = np.unique(cells)
                alone = touched[held[touched] == 1]
            if sum(len(peeled) for peeled, _ in rounds) < len(keys):
                continue
            for peeled, own in reversed(rounds):
                # the own cell is still zero, so the sum over all three is the one over the other two
                cells = made.cells[at[peeled]]
                made.cells[own] = prints[peeled] ^ cells[:, 0] ^ cells[:, 1] ^ cells[:, 2]
            return made
        raise RuntimeError(f"no filter of {len(keys)} keys in {_ATTEMPTS} attempts: are they distinct?")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.places(keys)
        cells = self.cells[at]
        return (cells[:, 0] ^ cells[:, 1] ^ cells[:, 2]) == prints


@dataclass
class Snapshot:
    """An immutable set of classes.

    ``texts`` (class_id, digest, key, text, n, last) are all classes of its batch, ``roots`` (class_id,
    root_batch, root_class) says which class of which snapshot each of them belongs to, ``entries`` (class_id,
    digest, key) are those that came up here first, and ``filters`` (shard, seed, segment, segments, cells) is
    asked before them.
    """

    number: int
    texts: DataFrame
    roots: DataFrame
    entries: DataFrame
    filters: DataFrame
    shards: int


_FILTER = "shard bigint, seed int, segment int, segments int, cells binary"


def _build_filter(key: tuple, table: pa.Table) -> pa.Table:
    made = Fuse.build(np.unique(table.column("key").to_numpy()).view(np.uint64))
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "seed": pa.array([made.seed], pa.int32()),
            "segment": pa.array([made.segment], pa.int32()),
            "segments": pa.array([made.segments], pa.int32()),
            "cells": pa.array([made.cells.tobytes()], pa.binary()),
        }
    )


def build_filters(entries: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of the keys of ``entries``."""
    sharded = entries.select(F.pmod("key", F.lit(shards)).alias("shard"), "key")
    return sharded.groupBy("shard").applyInArrow(_build_filter, _FILTER)


def _ask_filter(asked: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not asked.num_rows:
        return asked.select(["class_id", "digest"]).slice(0, 0)
    row = {c: filters.column(c)[0].as_py() for c in ("seed", "segment", "segments", "cells")}
    made = Fuse(row["seed"], row["segment"], row["segments"], np.frombuffer(row["cells"], dtype=np.uint8))
    found = made.holds(asked.column("key").to_numpy().view(np.uint64))
    return asked.select(["class_id", "digest"]).filter(pa.array(found))


def screen(classes: DataFrame, snapshot: Snapshot, n_classes: int) -> DataFrame:
    """(class_id, digest) of the classes that the snapshot's filters let through.

    Each filter meets its shard of the classes in parts of about ``SHARD_KEYS``, however many they are.
    """
    parts = max(1, ceil(n_classes / (SHARD_KEYS * snapshot.shards)))
    part = F.pmod(F.shiftright("key", 40), F.lit(parts))
    asked = classes.select("class_id", "digest", "key", F.pmod("key", F.lit(snapshot.shards)).alias("shard"), part.alias("part"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))
    filters = snapshot.filters.withColumn("part", F.explode(numbers))
    pairs = asked.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part"))
    return pairs.applyInArrow(_ask_filter, "class_id bigint, digest binary")


def confirm(positives: DataFrame, classes: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(class_id, root_batch, root_class) of the positives whose bytes the snapshot holds.

    Digests find the exact bucket; only classes with a bucket have their texts fetched and compared.
    """
    bucket = snapshot.entries.select("digest", F.col("class_id").alias("root_class"))
    meetings = stage(positives.join(bucket, "digest").select("class_id", "root_class"), "exact-meetings")
    # each side is cut down to the meetings on its own, so that neither table of texts is shuffled for the other
    ours = meetings.join(classes.select("class_id", "text"), "class_id")
    stored = snapshot.texts.select(F.col("class_id").alias("root_class"), F.col("text").alias("_text"))
    theirs = meetings.select("root_class").distinct().join(stored, "root_class")
    same = ours.join(theirs, "root_class").where(F.col("text") == F.col("_text"))
    return same.select("class_id", F.lit(snapshot.number).alias("root_batch"), "root_class")


def ingest(
    batch: DataFrame, snapshots: list[Snapshot], digest: Callable[[Column], Column] = sha256, shard_keys: int = SHARD_KEYS
) -> Snapshot:
    """The snapshot of a batch (doc_id, text) after the given ones.

    Copies are combined before the shuffle, so a text that fills the batch costs a row a task.
    """
    number = len(snapshots)
    texts = batch.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grouped = texts.groupBy(digest(F.col("text")).alias("digest"), "text").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")
    )
    numbered = grouped.withColumns({"key": F.xxhash64("digest"), "class_id": F.monotonically_increasing_id()})
    classes = stage(numbered, f"exact-classes-{number}")
    n_classes = classes.count()
    found = [stage(confirm(screen(classes, s, n_classes), classes, s), "exact-found") for s in snapshots]
    own = classes.select("class_id", F.lit(number).alias("root_batch"), F.col("class_id").alias("root_class"))
    if not found:
        roots, entries = own, classes.select("class_id", "digest", "key")
    else:
        known = reduce(DataFrame.unionByName, found)
        roots = stage(known.unionByName(own.join(known, "class_id", "left_anti")), "exact-roots")
        fresh = roots.where(F.col("root_batch") == number).select("class_id")
        entries = stage(classes.select("class_id", "digest", "key").join(fresh, "class_id", "left_semi"), "exact-entries")
    shards = max(1, ceil(n_classes / shard_keys))
    filters = stage(build_filters(entries, shards), "exact-filters")
    return Snapshot(number, classes, roots, entries, filters, shards)


def exact_duplicates(batches: list[DataFrame], digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row of all batches, in order of arrival.

    Texts are equal if their bytes are; a null text is empty. Of equal texts, in whichever batches, the row of
    the largest doc_id stays and ``group_size`` counts them all. Rows of one doc_id and text are one document
    given twice: they stay or go together. Rows without doc_id never stay; a group of only such rows has a null
    ``keep_id``. Digests that collide cost a comparison of texts and change no result. Empty batches add
    nothing, texts may be of any length, and columns other than doc_id and text are not read.
    """
    snapshots: list[Snapshot] = []
    for batch in batches:
        snapshots.append(ingest(batch, snapshots, digest))
    numbered = lambda s, df: df.withColumn("batch", F.lit(s.number))
    members = reduce(
        DataFrame.unionByName,
        [numbered(s, s.texts.select("class_id", "digest", "n", "last").join(s.roots, "class_id")) for s in snapshots],
    )
    totals = members.groupBy("root_batch", "root_class").agg(
        F.sum("n").alias("group_size"), F.max("last").alias("keep_id")
    )
    bucket = members.groupBy("batch", "digest").agg((F.count(F.lit(1)) == 1).alias("alone"))
    # stored, so that the join below shuffles both of its sides and can split a text that many rows have
    answers = stage(
        members.join(totals, ["root_batch", "root_class"])
        .join(bucket, ["batch", "digest"])
        .select("batch", "class_id", "digest", "alone", "keep_id", "group_size"),
        "exact-answers",
    )
    single, several = answers.where("alone"), stage(answers.where("NOT alone"), "exact-collided")
    rows = reduce(
        DataFrame.unionByName,
        [
            batch.select(
                F.lit(k).alias("batch"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
            ).withColumns({"digest": digest(F.col("text")), "text_sha256": F.sha2("text", 256)})
            for k, batch in enumerate(batches)
        ],
    )
    plain = rows.drop("text").join(single, ["batch", "digest"])
    # digests of several texts: these rows, and only these, are told apart by the text itself
    texts = reduce(DataFrame.unionByName, [numbered(s, s.texts.select("class_id", "text")) for s in snapshots])
    collided = rows.join(several.select("batch", "digest").distinct(), ["batch", "digest"], "left_semi")
    apart = collided.join(several.join(texts, ["batch", "class_id"]), ["batch", "digest", "text"])
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    both = plain.select(*columns).unionByName(apart.select(*columns))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return both.withColumn("kept", kept).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
