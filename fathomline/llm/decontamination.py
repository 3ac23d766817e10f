"""Benchmark passages inside documents, up to small edits.

Words are the symbols. Windows of documents and of benchmark items are embedded by CGK random walks: a
walk reads the symbol under it, writes it out and steps on or stays as a random bit of (step, symbol)
says, so that windows at a small edit distance agree in most places of the output. A hash function of the
Hamming LSH samples a few places of a walk; several walks with several samples repeat it. The size of the
windows, the places and the repetitions follow from the number of words of the item, so that items of every
length are found with the target recall (CLASSES). An item-sized stretch of the document around each
collision is then aligned with the item, and only true edit distances count. Collisions are aligned in
blocks of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fathomline.llm.minhash import slices
from fathomline.llm.words import Words, hash_runs, map_batches, mix, text_bytes

# Edits (words replaced, left out or put in) that still make a match, as a share of the item's words.
EDITS = 0.25
# Windows by the words of an item: (least words of the item, words of a window, sampled places, least
# different places among them, walks). A walk has two steps a word. Items and documents have a window at each
# word; there is no window over an item's end. Target: 0.98 of the items whose words have been edited as much
# as EDITS allows, at every length, by substitutions or by all kinds of edits.
CLASSES = [
    (1, 1, 2, 1, 1),
    (2, 2, 4, 2, 12),
    (3, 3, 6, 3, 16),
    (4, 3, 3, 2, 32),
    (5, 4, 3, 2, 24),
    (6, 4, 3, 3, 48),
    (8, 5, 4, 3, 32),
    (10, 6, 4, 3, 20),
    (14, 6, 4, 3, 12),
]
# Bytes of item text that are sent to every task at once; a larger benchmark is searched in parts.
ITEM_BYTES = 8 * 1024**2
# Collisions, and cells of the alignments, that a task holds at once.
COLLISIONS = 1 << 20
CELLS = 1 << 21
# Words that walk together: their arrays stay in the cache of a core.
WALKED = 1 << 14
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20

# ASCII letters and digits; texts are lower-cased before
WORD_BYTES = np.zeros(256, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    WORD_BYTES[_c] = _c
# What a character is to words: a separator, part of a word, a word of its own, or a mark that goes with
# the character before it.
_APART, _INSIDE, _ALONE, _MARK = range(4)
# Scripts written without blanks between words: Thai, Lao, Myanmar, Khmer, Tai Le to Tai Tham, Balinese,
# kana and bopomofo, Han, Yi, Javanese, Myanmar extended, Tai Viet, half-width kana, Han of the other planes.
_UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xA980, 0xA9DF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16F00, 0x18DFF), (0x1AFF0, 0x1B2FF),
    (0x20000, 0x3FFFF),
]


def character_classes() -> np.ndarray:
    """The class of every code point: letters and digits make words, in unspaced scripts each letter one."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            out[code] = _INSIDE
        elif kind in ("Mn", "Mc"):
            out[code] = _MARK
    for first, last in _UNSPACED:
        part = out[first : last + 1]
        letter = [unicodedata.category(chr(c)) != "Nd" for c in range(first, last + 1)]
        part[(part == _INSIDE) & letter] = _ALONE
    # variation selectors only say how the character before them looks
    out[0xFE00:0xFE10] = _APART
    out[0xE0100:0xE01F0] = _APART
    return out


def split_words(column: pa.Array, classes: np.ndarray) -> Words:
    """The words of lower-cased texts, by the classes of their characters."""
    data, bounds = text_bytes(column)
    size = len(data)
    kind = (WORD_BYTES[data] != 0).astype(np.uint8)
    lead = np.ones(size, dtype=bool)
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead[(data & 0xC0) == 0x80] = False
        follow = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
        head = data[wide]
        length = 2 + (head >= 0xE0) + (head >= 0xF0)
        code = head & np.array([0, 0, 0x1F, 0x0F, 0x07], dtype=np.uint32)[length]
        for step in (1, 2, 3):
            code = np.where(length > step, code << 6 | follow[wide + step], code)
        found = classes[np.minimum(code, 0x10FFFF)]
        kind[wide] = found
        for step in (1, 2, 3):
            on = (length > step) & (wide + step < size)
            kind[wide[on] + step] = found[on]
    mark = kind == _MARK
    if mark.any():
        at = np.flatnonzero(mark)
        before = np.maximum.accumulate(np.where(mark, -1, np.arange(size)))[at]
        own = bounds[np.searchsorted(bounds, at, side="right") - 1]
        kind[at] = np.where(before >= own, kind[before], _APART)
    begins = kind != _APART
    begins[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == _ALONE) & lead[1:] & ~mark[1:])
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < size)]
    begins[cut] = kind[cut] != _APART
    stops = kind != _APART
    stops[:-1] &= begins[1:] | (kind[1:] == _APART)
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(hash_runs(data, starts, ends), np.searchsorted(starts, bounds).astype(np.int64), starts, ends, data)


def walk_keys(
    symbols: np.ndarray, at: np.ndarray, walk: int, kind: tuple[int, int, int], early: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LSH keys of the windows that begin at ``at``, for one walk of a ``kind`` (size, sampled places, least words).

    (keys, which of ``at`` they belong to, keys of the first half of the places). A window whose first half is not
    in the filter ``early`` is given up there. A walk never leaves a zero, so the zero after a text or a
    window ends it. A walk that samples too few different words says too little (it stays on a common
    word), its key is 0.
    """
    size, sampled, least = kind
    rng = np.random.default_rng(1000 * size + walk)
    steps = 2 * size
    places = np.sort(rng.choice(steps, sampled, replace=False)).tolist()
    masks = rng.integers(0, 64, steps).astype(np.uint64)
    which, half = np.arange(len(at)), np.zeros(0, dtype=np.uint64)
    here, key, seen = at.astype(np.int64), np.full(len(at), np.uint64(walk + 1)), []
    end = here + size
    for step in range(places[-1] + 1):
        symbol = symbols[here]
        if step >= size:
            symbol *= here < end
        if step in places:
            key *= _GOLDEN
            key ^= symbol
            seen.append(here)
        # the random bit of this step and symbol: one of the 64 mixed bits of the symbol
        symbol >>= masks[step]
        symbol &= np.uint64(1)
        here = here + symbol.view(np.int64)
        if step == places[(sampled - 1) // 2]:
            half = key * _GOLDEN
            if early is not None:
                live = np.flatnonzero(early[half >> np.uint64(64 - _FILTER_BITS)])
                here, key, end, which, *seen = (x[live] for x in (here, key, end, which, *seen))
    key = mix(key)
    told, before = np.zeros(len(key), dtype=np.int8), np.int64(-1)
    for place in seen:
        told += (place != before) & (place < end) & (symbols[place] != 0)
        before = place
    key[told < least] = 0
    return key, which, half


def _filter(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return np.packbits(seen)


@dataclass
class Items:
    """The benchmark: words of all items one after another, item k at ``first[k]`` to ``first[k + 1]``.

    ``walks`` has (number of the walk, kind, sorted keys, word at which the window of each key begins, filter of
    the keys' first halves, filter of the keys).
    """

    ids: list[int]
    words: np.ndarray
    first: np.ndarray
    walks: list[tuple[int, tuple[int, int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    classes: np.ndarray


def _apart(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with a zero after each text, and the place of each word among them."""
    place = np.arange(len(hashes)) + owner
    symbols = np.zeros(place[-1] + 2 if len(place) else 1, dtype=np.uint64)
    symbols[place] = hashes
    return symbols, place


def prepare(ids: list[int], texts: list[str]) -> Items:
    """Hash the windows of all items; an item without words is none."""
    classes = character_classes()
    split = split_words(pa.array([t.lower() for t in texts], pa.string()), classes)
    length = np.diff(split.first)
    kept = np.flatnonzero(length)
    length = length[kept]
    words = np.maximum(split.hashes, np.uint64(1))
    first = np.append(0, np.cumsum(length))
    owner = np.repeat(np.arange(len(kept)), length)
    symbols, place = _apart(words, owner)
    left = first[owner + 1] - np.arange(len(words))
    out = Items([ids[k] for k in kept], words, first, [], classes)
    above = [c[0] for c in CLASSES[1:]] + [np.inf]
    for (fewest, size, sampled, least, walks), more in zip(CLASSES, above):
        own = (length >= fewest) & (length < more)
        at = np.flatnonzero(own[owner] & (left >= size))
        for walk in range(walks if len(at) else 0):
            kind = (size, sampled, least)
            keys, _, half = walk_keys(symbols, place[at], walk, kind)
            order = np.argsort(keys, kind="stable")[np.count_nonzero(keys == 0) :]
            keys, begins = keys[order], at[order].astype(np.int32)
            out.walks.append((walk, kind, keys, begins, _filter(half[order]), _filter(keys)))
    return out


def edit_distances(
    items: np.ndarray, texts: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least word edits between each row of ``items`` and any stretch of the same row of ``texts``.

    (edits, begin, end) of the best stretch of each row; what is not ``inside`` is no word and matches nothing.
    """
    rows, n = texts.shape
    ramp = np.arange(n + 1, dtype=np.int32)
    above = np.zeros((rows, n + 1), dtype=np.int32)
    begin = np.tile(ramp, (rows, 1))
    closed = ~inside * np.int32(items.shape[1] + 1)
    for row in range(items.shape[1]):
        diagonal = above[:, :-1] + (texts != items[:, row, None]) + closed
        upper = above[:, 1:] + 1
        best = np.empty_like(above)
        best[:, 0] = row + 1
        came = np.empty_like(begin)
        came[:, 0] = begin[:, 0]
        np.minimum(diagonal, upper, out=best[:, 1:])
        came[:, 1:] = np.where(diagonal <= upper, begin[:, :-1], begin[:, 1:])
        # a word of the text that the item lacks: the least value to the left plus the way from it
        best -= ramp
        reach = np.minimum.accumulate(best, axis=1)
        source = np.maximum.accumulate(np.where(best == reach, ramp, 0), axis=1)
        above, begin = reach + ramp, np.take_along_axis(came, source, axis=1)
    end = np.argmin(above, axis=1)
    at = np.arange(rows)
    return above[at, end], begin[at, end], end


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any stretch of ``text``: (edits, begin, end) of the best stretch."""
    row = np.asarray(text)[None]
    edits, begin, end = edit_distances(np.asarray(item)[None], row, np.ones(row.shape, dtype=bool))
    return int(edits[0]), int(begin[0]), int(end[0])


def _align(words: Words, items: Items, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows (text, item, edits, first word, end word) for the stretches that match; ``begin`` counts words of the text."""
    out = [np.zeros((0, 5), dtype=np.int64)]
    length = np.diff(items.first)[item]
    for n in np.unique(length):
        allowed = int(EDITS * n)
        width = n + 3 * allowed
        own = np.flatnonzero(length == n)
        for part in np.array_split(own, -(-len(own) * width // CELLS)):
            first, last = words.first[text[part]], words.first[text[part] + 1]
            start = first + begin[part] - allowed
            at = start[:, None] + np.arange(width)
            inside = (at >= first[:, None]) & (at < last[:, None])
            stretch = np.where(inside, np.maximum(words.hashes[np.where(inside, at, 0)], np.uint64(1)), np.uint64(0))
            wanted = items.words[items.first[item[part]][:, None] + np.arange(n)]
            # every word of the item that the stretch lacks costs an edit
            live, lacks = part, np.zeros(len(part), dtype=np.int64)
            for k in range(n):
                lacks += ~(stretch == wanted[:, k, None]).any(axis=1)
                fit = lacks <= allowed
                if 2 * np.count_nonzero(fit) < len(live) or k == n - 1:
                    live, lacks, stretch, wanted, inside = (x[fit] for x in (live, lacks, stretch, wanted, inside))
            edits, a, b = edit_distances(wanted, stretch, inside)
            good = np.flatnonzero(edits <= allowed)
            at = live[good]
            origin = begin[at] - allowed
            out.append(np.stack([text[at], item[at], edits[good], origin + a[good], origin + b[good]], axis=1))
    return np.concatenate(out)


def _best(rows: np.ndarray) -> np.ndarray:
    """Of the rows of each pair (text, item) the one of the fewest edits, the first of those."""
    rows = rows[np.lexsort(rows.T[::-1])]
    other = np.ones(len(rows), dtype=bool)
    other[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[other]


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def _matching(words: Words, items: Items) -> np.ndarray:
    """The best row of ``_align`` for each text and item with a window in common.

    Collisions are taken in blocks: those of one item within as many words as it may have edits meet the same
    stretch and are aligned once.
    """
    total = len(words.hashes)
    found = np.zeros((0, 5), dtype=np.int64)
    if not total or not items.ids:
        return found
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    symbols, places = _apart(np.maximum(words.hashes, np.uint64(1)), owner)
    length = np.diff(items.first)
    whose = np.repeat(np.arange(len(length)), length)
    step = (EDITS * length).astype(np.int64) + 1
    # one number for a text and a place: a text's places begin after all that an item may reach before it
    bias = 2 * int(length.max())
    base = words.first[:-1] + bias * (np.arange(len(words.first) - 1) + 1)
    span = int(words.first[-1]) + bias * (len(words.first) + 1)
    waiting, held = [], 0

    def settle(found):
        code = _distinct(np.concatenate(waiting))
        item, place = np.divmod(code, span)
        text = np.searchsorted(base - bias, place, side="right") - 1
        return _best(np.concatenate([found, _align(words, items, text, item, place - base[text])]))

    for walk, kind, own_keys, begins, early, seen in items.walks:
        early, seen = np.unpackbits(early).view(bool), np.unpackbits(seen).view(bool)
        at, keys = [], []
        for begin in range(0, total, WALKED):
            own, which, _ = walk_keys(symbols, places[begin : begin + WALKED], walk, kind, early)
            likely = np.flatnonzero(seen[own >> np.uint64(64 - _FILTER_BITS)])
            at.append(begin + which[likely]), keys.append(own[likely])
        at, keys = np.concatenate(at), np.concatenate(keys)
        low = np.searchsorted(own_keys, keys)
        count = np.searchsorted(own_keys, keys, side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        block = np.cumsum(count) // COLLISIONS
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1):
            each = count[part]
            entry = np.repeat(low[part] - np.cumsum(each) + each, each) + np.arange(each.sum())
            word = begins[entry]
            item = whose[word]
            place = np.repeat(at[part], each)
            text = owner[place]
            begin = place - words.first[text] - (word - items.first[item])
            # the first of the beginnings that share a stretch
            begin -= begin % step[item]
            waiting.append(_distinct(item * span + base[text] + begin))
            held += len(waiting[-1])
            if held > COLLISIONS:
                found, waiting, held = settle(found), [], 0
    return settle(found) if waiting else found


def find(texts: pa.Array, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(edits, first word, end word) of the best stretch for each pair (text, item) that matches."""
    rows = _matching(split_words(texts, items.classes), items)
    return {(text, item): (edits, a, b) for text, item, edits, a, b in rows.tolist()}


def _matches(items: Items):
    """A map from (id, lower-cased text) to the confirmed passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            ids, out = batch.column(0).to_pylist(), []
            for (text, item), (edits, a, b) in find(batch.column(1), items).items():
                out.append((ids[text], items.ids[item], edits, int(items.first[item + 1] - items.first[item]), a, b))
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"],
            )

    return run


def benchmark_items(benchmark: DataFrame) -> list[Broadcast]:
    """The hashed benchmark for all tasks, in as many parts as keep each to about ITEM_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    parts = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES
    out = []
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = own.orderBy("item_id", "text").collect()
        prepared = prepare([r.item_id for r in rows], [r.text for r in rows])
        # plain values: executors may lack this package
        out.append(benchmark.sparkSession.sparkContext.broadcast(vars(prepared)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns.

    A null text holds none; an item of one word drops every document that has the word. Decided row by row,
    so repeated ids and rows without id need no care.
    """
    schema = StructType([StructField("row", docs.schema), StructField("text", StringType())])
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), _lowered("text").alias("text"))

    def without(rows: DataFrame, part: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(**part.value)
            for batch in slices(batches, 512):
                ok = np.ones(batch.num_rows, dtype=bool)
                ok[[text for text, _ in find(batch.column(1), items)]] = False
                yield batch.filter(pa.array(ok))

        return rows.transform(map_batches, run, schema)

    return reduce(without, benchmark_items(benchmark), rows).select("row.*")


def _lowered(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, end_word): benchmark items that documents contain.

    An item counts as contained when some stretch of the document is at most a quarter of the item's
    words away from it in word edits; letters are lower-cased and everything but Unicode letters (with
    their marks) and digits only separates words; each letter of a script written without blanks is a
    word. Each pair of a document row and an item is reported once, with its best stretch
    (word positions, end exclusive). Items without words, null texts and documents without a match
    give no row; a repeated document row repeats its rows, a null doc_id stays null, other columns
    are ignored. The benchmark is hashed once and sent to every task, in parts where it is large.
    """
    columns = ("doc_id", "item_id", "edits", "item_words", "first_word", "end_word")
    schema = ", ".join(f"{c} long" for c in columns)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lowered("text").alias("text"))

    def searched(part: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _matches(Items(**part.value))(batches)

        return texts.transform(map_batches, run, schema)

    return reduce(DataFrame.unionAll, map(searched, benchmark_items(benchmark)))
