"""Phrase collocations from depth-truncated suffix subtrees.

Texts become blocks of word numbers. Vertical partitioning: words, then longer and longer prefixes of words,
are counted and extended as long as they occur more often than a group's memory budget allows; all other
prefixes are dealt into groups by their hash. Every suffix, cut after ``DEPTH`` words or at the end of its
piece, goes to the group of its shortest prefix within the budget. A group sorts its suffixes once, which is
its subtree in leaf order; the count of a phrase is the total of the leaves below it.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fathomline.llm.words import map_batches, mix, word_hashes
from fathomline.operators.relational import top_ties
from fathomline.sources.tables import stage

DEPTH = 5
LEAST = 100
TOP = 2000
# Words of a block, the unit in which equal suffixes are combined before the shuffle.
BLOCK_WORDS = 3 << 18
# Bytes of an Arrow batch of blocks, which are a megabyte or two each.
BATCH_BYTES = 4 << 20
# Suffixes of a group on average; a prefix that may have more than a quarter of it is extended by another word.
GROUP_SUFFIXES = 1 << 20
_SEEDS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# the byte that counts, 0 for a separator; NUL is part of a word and takes a byte that UTF-8 never uses
_WORD = _LOWER.copy()
_WORD[0] = 0xFF
_WORD[_BREAK] = 0
_WORD[list(b" \t")] = 0


def _byte_table(seed: int) -> np.ndarray:
    """``_WORD`` with its bytes exchanged for others, which gives each word another hash."""
    if not seed:
        return _WORD
    other = np.concatenate([[0], 1 + np.random.default_rng(seed).permutation(255)]).astype(np.uint8)
    return other[_WORD]


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_BYTES`` for the jobs inside, all of which run to their end there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# blocks ------------------------------------------------------------------------------------------

_BLOCK = "lang string, hashes array<bigint>, words array<string>, counts array<bigint>, ids binary, ends binary, n bigint"


def _narrow(n: int) -> np.dtype:
    """The type of numbers up to ``n``."""
    return np.dtype(np.uint16 if n < 1 << 16 else np.uint32)


def _piece_ends(words) -> np.ndarray:
    """Whether a piece ends after each word: at a break character or at the end of the text."""
    ends = np.zeros(len(words.hashes), dtype=bool)
    if len(ends):
        seen = np.concatenate([[0], np.cumsum(_BREAK[words.data])])
        ends[:-1] = seen[words.starts[1:]] > seen[words.ends[:-1]]
        last = words.first[1:][np.diff(words.first) > 0] - 1
        ends[last] = True
    return ends


class _Words:
    """The words of one language that a task has read and not yet written."""

    def __init__(self):
        self.hashes, self.ends, self.known, self.names = [], [], [], []
        self.n = 0

    def add(self, column: pa.Array, table: np.ndarray) -> None:
        words = word_hashes(column, table)
        if not len(words.hashes):
            return
        known, at = np.unique(words.hashes, return_index=True)
        data = _LOWER[words.data].tobytes()
        starts, ends = words.starts[at].tolist(), words.ends[at].tolist()
        self.names.append(np.array([data[a:b] for a, b in zip(starts, ends)], dtype=object))
        self.known.append(known)
        self.hashes.append(words.hashes)
        self.ends.append(_piece_ends(words))
        self.n += len(words.hashes)

    def blocks(self, lang: str):
        """Blocks of at most ``BLOCK_WORDS`` words and the ``DEPTH`` - 1 that follow them, which only
        complete the suffixes of the block."""
        hashes, ends = np.concatenate(self.hashes), np.concatenate(self.ends)
        known, at = np.unique(np.concatenate(self.known), return_index=True)
        names = np.concatenate(self.names)[at]
        for start in range(0, len(hashes), BLOCK_WORDS):
            stop = min(start + BLOCK_WORDS, len(hashes))
            part = hashes[start : stop + DEPTH - 1]
            used, ids = np.unique(part, return_inverse=True)
            counts = np.bincount(ids[: stop - start], minlength=len(used))
            words = names[np.searchsorted(known, used)].tolist()
            whole = [0, len(used)]
            as_list = lambda values: pa.ListArray.from_arrays(pa.array(whole, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()),
                    as_list(pa.array(used.view(np.int64), pa.int64())),
                    as_list(pa.array(words, pa.binary()).cast(pa.string())),
                    as_list(pa.array(counts, pa.int64())),
                    pa.array([ids.astype(_narrow(len(used))).tobytes()], pa.binary()),
                    pa.array([np.packbits(ends[start : stop + DEPTH - 1]).tobytes()], pa.binary()),
                    pa.array([stop - start], pa.int64()),
                ],
                names=["lang", "hashes", "words", "counts", "ids", "ends", "n"],
            )


def _encoder(seed: int):
    def encode(batches):
        table, open_ = _byte_table(seed), {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                open_.setdefault(lang, _Words()).add(batch.column("text").filter(pc.equal(langs, lang)), table)
            if sum(w.n for w in open_.values()) >= BLOCK_WORDS:
                for lang, words in open_.items():
                    if words.n:
                        yield from words.blocks(lang)
                open_ = {}
        for lang, words in open_.items():
            if words.n:
                yield from words.blocks(lang)

    return encode


# prefixes and groups -----------------------------------------------------------------------------


def _lang_key(lang: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype=np.uint64)


def _extend(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of prefixes that are longer by one word."""
    return mix(keys * _STEP ^ hashes)


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _suffixes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block, its suffixes as numbers of words from 1 (0 beyond the end of the piece), and
    their lengths."""
    hashes = np.array(row["hashes"], dtype=np.int64).view(np.uint64)
    ids = np.frombuffer(row["ids"], dtype=_narrow(len(hashes))).astype(np.int32)
    ends = np.unpackbits(np.frombuffer(row["ends"], dtype=np.uint8))[: len(ids)].astype(bool)
    n = row["n"]
    # position of the end of each word's piece; the look-ahead may stop before it
    stops = np.append(np.flatnonzero(ends), len(ids) - 1)
    end = stops[np.searchsorted(stops, np.arange(n))]
    length = np.minimum(end - np.arange(n) + 1, DEPTH)
    padded = np.concatenate([ids + 1, np.zeros(DEPTH, dtype=np.int32)])
    columns = np.stack([np.where(length > k, padded[k : k + n], 0) for k in range(DEPTH)])
    return hashes, columns, length


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in ("lang", "ids", "ends", "n")} | {
                "hashes": batch.column("hashes")[i].values.to_numpy()
            }


def _prefixes(row: dict, heavy: list[np.ndarray], depth: int):
    """Prefixes of ``depth`` words of a block, below the prefixes in ``heavy`` (sorted keys by length - 1):
    their word hashes (one row each), keys and counts."""
    hashes, columns, length = _suffixes(row)
    at = np.flatnonzero(length >= depth)
    keys = np.broadcast_to(_lang_key(row["lang"]), len(at))
    for known, column in zip(heavy, columns[:depth]):
        keys = _extend(keys, hashes[column[at] - 1])
        inside = _has(known, keys)
        at, keys = at[inside], keys[inside]
    found = columns[:depth, at]
    order = _order(found)
    found = found[:, order]
    first = np.flatnonzero(_changes(found))
    return hashes[found[:, first].T - 1], np.diff(np.append(first, len(at)))


def _prefix_batch(lang: str, phrases: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    count, depth = phrases.shape
    offsets = pa.array(np.arange(0, count * depth + 1, depth), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * count, pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(phrases.ravel().view(np.int64))),
            pa.array(n, pa.int64()),
        ],
        names=["lang", "phrase", "n"],
    )


_PREFIX = "lang string, phrase array<bigint>, n bigint"


def _longer_prefixes(blocks: DataFrame, heavy: list[np.ndarray], budget: int, n_words: int) -> DataFrame:
    """(lang, phrase) of all prefixes one word longer than those in ``heavy`` that occur more than ``budget``
    times, and of some that occur half as often.

    A block only tells of prefixes that have more than its share of half the budget. What all blocks leave out
    is less than that half, so a prefix whose told counts stay below the other half is within the budget.
    """
    depth = len(heavy) + 1

    def tell(batches):
        for row in _rows(batches):
            phrases, n = _prefixes(row, heavy, depth)
            told = n > budget * row["n"] / (2 * n_words)
            if told.any():
                yield _prefix_batch(row["lang"], phrases[told], n[told])

    told = map_batches(blocks, tell, _PREFIX).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return told.where(2 * F.col("n") >= budget).select("lang", "phrase")


def _count_prefixes(blocks: DataFrame, heavy: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, n) of the prefixes in ``heavy`` of two words and more."""

    def count(batches):
        for row in _rows(batches):
            for depth in range(2, len(heavy) + 1):
                phrases, n = _prefixes(row, heavy[:depth], depth)
                if len(n):
                    yield _prefix_batch(row["lang"], phrases, n)

    return map_batches(blocks, count, _PREFIX).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _keys_of(prefixes: DataFrame) -> np.ndarray:
    """Sorted keys of prefixes with at least half the budget: of each length no more than the number of words
    over that half, so one in ``GROUP_SUFFIXES`` / 8 words of the table."""
    rows = prefixes.select("lang", "phrase").toArrow()
    keys = np.zeros(rows.num_rows, dtype=np.uint64)
    for i, (lang, phrase) in enumerate(zip(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist())):
        key = _lang_key(lang)
        for word in np.array(phrase, dtype=np.int64).view(np.uint64):
            key = _extend(key, word)
        keys[i] = key[0]
    return np.sort(keys)


_PIECE = "bucket bigint, lang string, n int, hashes binary, rows binary"


def _deal(blocks: DataFrame, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """Suffixes of every block by group: different ones once, with their count and the length of the prefix
    that decided on the group. Suffixes of which all prefixes are over the budget have been counted already."""

    def deal(batches):
        for row in _rows(batches):
            hashes, columns, length = _suffixes(row)
            n = row["n"]
            keys = np.broadcast_to(_lang_key(row["lang"]), n).copy()
            least, at = np.zeros(n, dtype=np.uint8), np.arange(n)
            for k in range(DEPTH):
                at = at[length[at] > k]
                keys[at] = _extend(keys[at], hashes[columns[k, at] - 1])
                over = _has(heavy[k], keys[at]) if k < len(heavy) else np.zeros(len(at), dtype=bool)
                least[at[~over]] = k + 1
                at = at[over]
                if not len(at):
                    break
            open_ = np.flatnonzero(least)
            columns, least = columns[:, open_], least[open_]
            bucket = (keys[open_] % np.uint64(groups)).astype(np.int64)
            if not len(open_):
                continue
            order = _order(columns, bucket)
            columns, least, bucket = columns[:, order], least[order], bucket[order]
            first = np.flatnonzero(_changes(columns) | _changes(bucket[None]))
            counts = np.diff(np.append(first, len(order)))
            columns, least, bucket = columns[:, first], least[first], bucket[first]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            out: dict[str, list] = {c: [] for c in ("bucket", "n", "hashes", "rows")}
            pack = zstandard.ZstdCompressor(level=3).compress
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = columns[:, a:b]
                used, ids = np.unique(part, return_inverse=True)
                ids = ids.reshape(part.shape) + (0 if used[0] == 0 else 1)
                used = used[used > 0]
                out["bucket"].append(int(bucket[a]))
                out["n"].append(b - a)
                out["hashes"].append(hashes[used - 1].tobytes())
                # place by place, so that what neighbours share lies together
                body = [ids.astype(_narrow(len(used))), counts[a:b].astype(np.uint32), least[a:b]]
                out["rows"].append(pack(b"".join(x.tobytes() for x in body)))
            kinds = {"bucket": pa.int64(), "n": pa.int32()}
            arrays = {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()}
            arrays["lang"] = pa.array([row["lang"]] * len(out["n"]), pa.string())
            names = ["bucket", "lang", "n", "hashes", "rows"]
            yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names=names)

    return map_batches(blocks, deal, _PIECE)


def _order(columns: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """The order of rows of word numbers (one array a place), within buckets if given.

    Numbers below two to the 21, as all but huge vocabularies have, go three into a sort key.
    """
    keys = list(columns)
    if columns.size and columns.max() < 1 << 21:
        keys = []
        for start in range(0, len(columns), 3):
            key = columns[start].astype(np.int64)
            for column in columns[start + 1 : start + 3]:
                key <<= 21
                key |= column
            keys.append(key)
    return np.lexsort([*keys[::-1], *([] if bucket is None else [bucket])])


def _changes(columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.zeros(columns.shape[1], dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _subtree(least_count: int):
    def count(key: tuple, pieces: pa.Table) -> pa.Table:
        hashes, columns, counts, least = [], [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for n, own, rows in zip(*(pieces.column(c) for c in ("n", "hashes", "rows"))):
            n, own, rows = n.as_py(), np.frombuffer(own.as_buffer(), dtype=np.uint64), unpack(rows.as_buffer())
            narrow = _narrow(len(own))
            wide = DEPTH * n * narrow.itemsize
            hashes.append(own)
            columns.append(np.frombuffer(rows, dtype=narrow, count=DEPTH * n).reshape(DEPTH, n))
            counts.append(np.frombuffer(rows, dtype=np.uint32, count=n, offset=wide))
            least.append(np.frombuffer(rows, dtype=np.uint8, count=n, offset=wide + 4 * n))
        known, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        at = 0
        for i, own in enumerate(hashes):
            table = np.concatenate([[0], numbers[at : at + len(own)] + 1]).astype(np.int32)
            columns[i] = table[columns[i]]
            at += len(own)
        columns = np.concatenate(columns, axis=1)
        counts, least = np.concatenate(counts).astype(np.int64), np.concatenate(least)
        order = _order(columns)
        columns, counts, least = columns[:, order], counts[order], least[order]
        phrases, totals = [], []
        for depth in range(1, DEPTH + 1):
            # a branch that is too light stays so below: only the others go deeper
            inside = columns[depth - 1] > 0
            columns, counts, least = columns[:, inside], counts[inside], least[inside]
            if not len(counts):
                break
            first = np.flatnonzero(_changes(columns[:depth]))
            total = np.add.reduceat(counts, first)
            enough = total >= least_count
            told = enough & (least[first] <= depth)
            phrases += known[columns[:depth, first[told]].T - 1].view(np.int64).tolist()
            totals.append(total[told])
            stays = np.repeat(enough, np.diff(np.append(first, len(counts))))
            columns, counts, least = columns[:, stays], counts[stays], least[stays]
        n = sum(map(len, totals))
        return pa.table(
            {
                "lang": pa.array([key[1].as_py()] * n, pa.string()),
                "phrase": pa.array(phrases, pa.list_(pa.int64())),
                "n": pa.array(np.concatenate(totals) if totals else [], pa.int64()),
            }
        )

    return count


def _encode(docs: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Blocks, and (lang, hash, word, n) of all words.

    Words are told apart by 64-bit hashes. If two words of the table share one, which among a million words
    has a chance of 3 in 10^8, all hashes are taken anew under another seed.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{language}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    for seed in range(_SEEDS):
        blocks = stage(map_batches(texts, _encoder(seed), _BLOCK), "phrase-blocks")
        listed = blocks.select("lang", F.inline(F.arrays_zip("hashes", "words", "counts"))).toDF("lang", "hash", "word", "n")
        words = stage(listed.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n")), "phrase-words")
        shared = words.select("hash", "word").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        if shared.isEmpty():
            return blocks, words.where("n > 0")
    raise RuntimeError(f"words share a hash under each of {_SEEDS} seeds")


def phrase_counts(
    blocks: DataFrame, words: DataFrame, least: int = LEAST, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """(lang, phrase, n): the occurrences of every phrase of 1 to ``DEPTH`` words with at least ``least`` of them."""
    blocks = blocks.select("lang", "hashes", "ids", "ends", "n")
    budget = max(1, group_suffixes // 4)
    n = words.agg(F.sum("n")).first()[0] or 0
    single = words.select("lang", F.array("hash").alias("phrase"), "n")
    longest, heavy = single.where(F.col("n") > budget), []
    while len(keys := _keys_of(longest)):
        heavy.append(keys)
        if len(heavy) == DEPTH:
            break
        longest = stage(_longer_prefixes(blocks, list(heavy), budget, n), "phrase-prefixes")
    pieces = _deal(blocks, heavy, max(1, ceil(n / group_suffixes)))
    found = pieces.groupBy("bucket", "lang").applyInArrow(_subtree(least), _PREFIX)
    if heavy:
        found = found.unionByName(single.where((F.col("n") > budget) & (F.col("n") >= least)))
    if len(heavy) > 1:
        found = found.unionByName(_count_prefixes(blocks, heavy).where(F.col("n") >= least))
    return stage(found, "phrase-counts")


# scores ------------------------------------------------------------------------------------------


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)): the products as decimals of 38 digits, the quotient as a long."""
    whole = lambda c: c.cast("decimal(19,0)")
    columns = F.struct(
        (F.lit(1000).cast("decimal(4,0)") * whole(a)).cast("decimal(22,0)").alias("a"),
        whole(n).alias("n"),
        (whole(left) * whole(right)).cast("decimal(38,0)").alias("lr"),
    )
    return F.transform(F.array(columns), lambda s: F.call_function("div", (s["a"] * s["n"]).cast("decimal(38,0)"), s["lr"]))[0]


def collocations(
    docs: DataFrame, language: str = "lang", least: int = LEAST, top: int = TOP, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Letters A to Z are lower-cased, texts cut into pieces at ``.,;:!?`` and ``\\n`` to ``\\r``, pieces into words
    at blanks and tabs; a null language is ``und``, a null text empty. Phrases of 2 to 5 words that occur at
    least ``least`` times are scored by their weakest cut, ties to the shorter first part. A phrase that always
    stands inside the same longer one is left out. Ties in score and count go by the bytes of the phrase.
    Repeated rows count again; an empty table has no phrases; texts may be of any length (blocks cut them,
    suffixes run on); other columns are not read.
    """
    with _small_batches(docs.sparkSession):
        blocks, words = _encode(docs, language)
        counts = phrase_counts(blocks, words, least, group_suffixes)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    size = F.size("phrase")
    phrases = counts.withColumnRenamed("n", "a")
    longer = phrases.where(size > 2)
    # every longer phrase around a candidate with its count implies one that is longer by one word
    covered = longer.select("lang", F.slice("phrase", F.lit(1), size - 1).alias("phrase"), "a").unionByName(
        longer.select("lang", F.slice("phrase", F.lit(2), size - 1).alias("phrase"), "a")
    )
    candidates = stage(
        phrases.where(size > 1).join(covered.distinct(), ["lang", "phrase", "a"], "left_anti"), "phrase-candidates"
    )
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cut = (
        cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k")))
        .withColumn("right", F.slice("phrase", F.col("k") + 1, size - F.col("k")))
        .join(part("left", "l"), ["lang", "left"])
        .join(part("right", "r"), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    )
    weakest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = stage(
        weakest.select(
            "lang", "phrase", "a", "n", "cut.l", "cut.r", F.struct("cut.score", "a").alias("weight")
        ),
        "phrase-scores",
    )
    best = stage(top_ties(scored, ["lang"], "weight", top), "phrase-best")
    spelt = (
        best.select("lang", "phrase", F.posexplode("phrase").alias("i", "hash"))
        .join(words.select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("lang", "phrase")
        .agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelling"))
    )
    named = best.join(spelt, ["lang", "phrase"]).withColumn("phrase", F.array_join("spelling.word", " "))
    order = W.partitionBy("lang").orderBy(F.desc("weight"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("weight.score").alias("score"))
