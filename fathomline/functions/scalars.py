"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log10_plus1(x: Column | str) -> Column:
    return F.log10(_col(x) + 1)


def reciprocal(x: Column | str) -> Column:
    """1/x, null for 0."""
    return F.try_divide(F.lit(1.0), _col(x))


def mean_of(*xs: Column | str) -> Column:
    """Row-wise mean of columns; null if one of them is null."""
    total = sum((_col(x) for x in xs[1:]), _col(xs[0]))
    return total / F.lit(float(len(xs)))


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Conditional that is null where the condition is null (``otherwise`` would take the else branch)."""
    return F.when(cond, yes).when(~cond, no)


def is_binomial(name: Column | str, several: str = "spp") -> Column:
    """A name of at least two words without the mark for several species of a genus."""
    name = _col(name)
    return F.contains(name, F.lit(" ")) & ~F.contains(name, F.lit(several))


def recode(x: Column | str, mapping: dict[str, str]) -> Column:
    """Replace labels by ``mapping`` (old to new) and leave all others as they are."""
    x = _col(x)
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[x], x) if pairs else x


def collapse(x: Column | str, groups: dict[str, list[str]]) -> Column:
    """Replace each member of ``groups`` (group name to members) by its group, others unchanged."""
    return recode(x, {member: group for group, members in groups.items() for member in members})


def label_ordinal(x: Column | str, levels: list[str], reverse: bool = False) -> Column:
    """Position (from 1) of a label in ``levels``, or in the reversed list; null for other labels."""
    levels = levels[::-1] if reverse else levels
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(x))
    return F.when(position > 0, position)
