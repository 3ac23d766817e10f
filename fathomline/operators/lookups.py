"""Look-ups that tell, from the pass that does them, whether a key repeats and how many rows found a match."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, functions as F


@dataclass
class Lookup:
    """``rows`` is the result; ``report`` needs it to have been computed once (written, counted, collected)."""

    rows: DataFrame
    _keys: Observation
    _matches: Observation

    def report(self) -> dict[str, int]:
        """keys and repeated_keys of the table, rows, matched and unmatched of the look-up.

        A side that the pass did not have to read, because the other one is empty, counts nothing.
        """
        keys = _figures(self._keys, ["keys", "repeated_keys"])
        matches = _figures(self._matches, ["rows", "matched"])
        return {
            "keys": keys["keys"],
            "repeated_keys": keys["repeated_keys"],
            "rows": matches["rows"],
            "matched": matches["matched"],
            "unmatched": matches["rows"] - matches["matched"],
        }


def _figures(observation: Observation, names: list[str]) -> dict[str, int]:
    try:
        return observation.get
    except Py4JJavaError as error:
        # the planner has taken an empty side out, and with it the observation
        if "AssertionError" not in str(error.java_exception):
            raise
        return dict.fromkeys(names, 0)


def checked_lookup(rows: DataFrame, table: DataFrame, on: list[str], repeated: str = "error") -> Lookup:
    """All ``rows``, each once, with the columns of ``table`` under its key (null where there is none).

    The table is reduced to one row per key before the join, so rows are never multiplied. A key that repeats
    is an error, or with ``repeated="report"`` counted, and the least of its rows is taken. Counts are
    taken by observations on both sides of the same plan, without another scan. Null keys match nothing.
    """
    if repeated not in ("error", "report"):
        raise ValueError("repeated must be 'error' or 'report'")
    others = [c for c in table.columns if c not in on]
    known = table.dropna(subset=on)
    # the least row, if need be: only sums and minima, which combine before the shuffle
    one = known.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.lit(True).alias("_"), *[f"`{c}`" for c in others])).alias("_found")
    )
    keys, matches = Observation(), Observation()
    one = one.observe(keys, F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    if repeated == "error":
        message = F.concat(F.lit("the table repeats the key "), F.to_json(F.struct(*on)))
        one = one.where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True))
    joined = rows.join(one.select(*on, "_found"), on, "left")
    found = F.col("_found").isNotNull()
    joined = joined.observe(matches, F.count(F.lit(1)).alias("rows"), F.count_if(found).alias("matched"))
    return Lookup(joined.select(*rows.columns, *[F.col(f"_found.`{c}`").alias(c) for c in others]), keys, matches)
