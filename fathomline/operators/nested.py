"""Nested records: an array of structs per key, and back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.operators.relational import join_on, keep_members
from fathomline.sources.tables import stored

# Records of one array, about: no row holds more than twice as many.
CHUNK_RECORDS = 10_000


def _n_chunks(df: DataFrame, by: list[str], chunk_records: int) -> int:
    """Chunks that the key of most records needs, from one aggregate."""
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(largest or 0) // chunk_records))


def nest(
    df: DataFrame,
    by: list[str],
    identity: list[str],
    out: str,
    n_chunks: int | None = None,
    chunk_records: int = CHUNK_RECORDS,
) -> DataFrame:
    """Gather all columns but ``by`` into arrays of structs per key, each sorted by ``identity``.

    Rows are (key, chunk). The number of chunks follows from the key of most records, so that an array has
    about ``chunk_records`` at most; ``n_chunks`` sets it by hand. Equal records are counted first and dealt
    out evenly, different ones by a hash of their fields, so neither a large key nor one record that fills it
    meets in one row. Consumers read all rows of a key: sums and maxima over its chunks, ``unnest`` for the
    records, ``only_value`` for the field of a single one.
    """
    fields = [*identity, *[c for c in df.columns if c not in by and c not in identity]]
    if n_chunks is None:
        df = stored(df, "nest")
        n_chunks = _n_chunks(df, by, chunk_records)
    counted = df.groupBy(*by, *fields).agg(F.count(F.lit(1)).alias("_n"))
    total, j = F.lit(n_chunks).cast("bigint"), F.col("_j")
    shares = F.sequence(F.lit(0).cast("bigint"), F.least("_n", total) - 1)
    times = F.floor(F.col("_n") / total) + (j < F.pmod("_n", total)).cast("bigint")
    dealt = counted.withColumn("_j", F.explode(shares)).select(
        *by, F.pmod(F.xxhash64(*fields) + j, total).alias("chunk"), F.struct(*fields).alias("_record"), times.cast("int").alias("_times")
    )
    several = F.collect_list(F.array_repeat("_record", F.col("_times")))
    return dealt.groupBy(*by, "chunk").agg(F.array_sort(F.flatten(several)).alias(out))


def nest_tables(
    keys: DataFrame,
    tables: dict[str, tuple[DataFrame, list[str]]],
    by: list[str],
    n_chunks: int | None = None,
    chunk_records: int = CHUNK_RECORDS,
) -> DataFrame:
    """Nest several record tables (name to table and identity columns) side by side for the given keys.

    Rows are (key, chunk); every key has chunk 0, and a table without records in a chunk is null there.
    Unnesting one of the columns gives the records of its table and nothing else.
    """
    wide = keys.select(*by).distinct().withColumn("chunk", F.lit(0).cast("bigint"))
    for name, (records, identity) in tables.items():
        nested = nest(keep_members(records, keys, by), by, identity, name, n_chunks, chunk_records)
        wide = join_on(wide, nested, [*by, "chunk"], "full")
    return wide


def unnest(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row per record of a nested column, its fields as columns; a key without records is dropped
    unless ``keep_empty``."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline_outer(column) if keep_empty else F.inline(column))


def only_value(nested: DataFrame, by: list[str], records: str, field: str) -> DataFrame:
    """(key, field): the field of each key's single record; an error for a key with several."""
    found = nested.groupBy(*by).agg(
        F.sum(F.size(records)).alias("_n"), F.max(F.get(records, F.lit(0))[field]).alias("_value")
    )
    checked = F.when(F.col("_n") == 1, F.col("_value")).otherwise(
        F.raise_error(F.lit(f"{records} must hold exactly one record for each key")).cast("double")
    )
    return found.select(*by, checked.alias(field))


def all_values(records: str, field: str) -> Column:
    """The field of all records, as an array."""
    return F.col(records)[field]
