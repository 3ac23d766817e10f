"""What each filter of a chain removes, alone and with the others, for every order of the chain.

Documents are counted once by part and pattern of failed filters. The counts of a part are then a tensor with
one axis of length two (pass, fail) a filter; every figure of every step is a contraction of that tensor which
takes pass, fail or both along each axis. Nothing is counted again for another order.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from fathomline.llm.words import map_batches, text_bytes
from fathomline.sources.tables import stage

LEAST_WORDS = 200
LEAST_DISTINCT = 50  # distinct words, percent of all words
MOST_CAPITALS = 2  # percent of code points
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))

FILTERS = ["A", "B", "C", "D", "E"]
PASS, FAIL, ANY = (1, 0), (0, 1), (1, 1)


def _text_filters(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails the filters A to D."""
    # bytes.split() splits at exactly blank, \t, \n, \v, \f and \r
    words = text.split()
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        len(text.translate(None, SIGNS)) < len(text),
    )


def _flag_batches(batches):
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        fails = np.array([_text_filters(t) for t in texts], dtype=bool).reshape(len(texts), 4)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                *[pa.array(fails[:, i]) for i in range(4)],
            ],
            names=["doc_id", "part", "digest", *FILTERS[:4]],
        )


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, A .. E): one row per document, true where it fails the filter.

    A: fewer than 200 words; B: under half of the words distinct; C: more than 2 % capitals; D: holds one of
    ``#$%&*|``; E: a smaller doc_id has the same text (equal SHA-256). Words are maximal runs of other bytes
    than blank and ``\\t`` to ``\\r``. A null text is empty, a null part the empty string. A row without
    doc_id never fails E, nor do rows of one doc_id fail it because of each other. Texts may be of any length;
    an empty table gives none; other columns, whatever their names, are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "text")
    schema = StructType(
        [
            *[rows.schema[c] for c in ("doc_id", "part")],
            StructField("digest", BinaryType()),
            *[StructField(f, BooleanType()) for f in FILTERS[:4]],
        ]
    )
    flags = stage(map_batches(rows, _flag_batches, schema), "filter-flags")
    # stored, so that the join shuffles both of its sides and can split a text that many rows have
    repeated = flags.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stage(repeated.where("_n > 1").select("digest", "_first"), "filter-first")
    later = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return flags.join(first, "digest", "left").withColumn("E", later).select("doc_id", "part", *FILTERS)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic`` (labels quality = 1, toxic = 1); a document counts once however many
    labels it has, and one without any is neither."""
    one = labels.groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    )
    known = stage(one, "filter-labels")
    missing = F.lit(False)
    return rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, missing) for c in ("good", "toxic")})


def selections(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of ``n`` filters, and for each figure the choice along each axis at every step of each
    order: arrays of (orders * n, n, 2) zeros and ones."""
    orders = list(permutations(range(n)))
    chosen: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in orders:
        for step, axis in enumerate(order):
            before, this = order[:step], {axis: FAIL}
            chosen["kept"].append({a: PASS for a in order[: step + 1]})
            chosen["removed"].append({a: PASS for a in before} | this)
            chosen["failing"].append(this)
            chosen["unique_fails"].append({a: PASS for a in range(n)} | this)
    as_array = lambda rows: np.array([[row.get(a, ANY) for a in range(n)] for row in rows], dtype=np.int64)
    return orders, {name: as_array(rows) for name, rows in chosen.items()}


def contract(tensor: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Sums of ``tensor`` (measures, 2, .., 2) over the chosen cells, for every row of ``choice``: (rows, measures)."""
    n = tensor.ndim - 1
    # axis 0 numbers the rows, axis 1 the measures, the others the filters
    operands = [tensor, [1, *range(2, n + 2)]]
    for axis in range(n):
        operands += [choice[:, axis], [0, axis + 2]]
    return np.einsum(*operands, [0, 1], optimize="greedy")


def audit(rows: DataFrame, filters: list[str], by: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (removed by the step's filter, summed over all orders).

    ``rows`` has a boolean column per filter (true: fails, null: passes) named by one letter each. Counts are
    exact 64-bit integers. At most two to the number of filters cells of a part meet in one task.
    """
    n = len(filters)
    fails = [F.coalesce(F.col(f"`{f}`"), F.lit(False)).cast("int") for f in filters]
    cell = sum((f * 2 ** (n - 1 - i) for i, f in enumerate(fails)), F.lit(0))
    number = lambda c: F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("bigint"))
    cells = rows.groupBy(F.col(f"`{by}`").alias("part"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("docs"), number(good).alias("good"), number(toxic).alias("toxic")
    )

    def figures(key: tuple, table: pa.Table) -> pa.Table:
        tensor = np.zeros((3, 2**n), dtype=np.int64)
        at = table.column("cell").to_numpy()
        for i, measure in enumerate(("docs", "good", "toxic")):
            tensor[i, at] = table.column(measure).to_numpy()
        tensor = tensor.reshape(3, *[2] * n)
        orders, choices = selections(n)
        got = {name: contract(tensor, choice) for name, choice in choices.items()}
        letter = np.array(orders).ravel()
        removed = got["removed"]
        shapley = np.array([removed[letter == f, 0].sum() for f in range(n)])
        columns = {
            "kept": got["kept"][:, 0],
            "removed": removed[:, 0],
            "redundant": got["failing"][:, 0] - removed[:, 0],
            "unique_fails": got["unique_fails"][:, 0],
            "good_lost": removed[:, 1],
            "toxic_lost": removed[:, 2],
            "shapley": shapley[letter],
        }
        names = ["".join(filters[f] for f in order) for order in orders]
        head = {
            "part": pa.array([key[0].as_py()] * len(letter), pa.string()),
            "filter_order": pa.array(np.repeat(names, n), pa.string()),
            "step": pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32()),
        }
        return pa.table(head | {k: pa.array(v, pa.int64()) for k, v in columns.items()})

    counts = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts)
    return cells.groupBy("part").applyInArrow(figures, schema)
