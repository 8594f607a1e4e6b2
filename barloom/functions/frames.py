"""Window frames over the calendar position of a row.

Panels are sparse.  ``idx`` is the row's position in the calendar shared by all instruments, so a
RANGE frame over it gives exactly what a row offset over the padded grid would give: an instrument
that did not print ``k`` slots ago yields NULL, and an ``n``-slot extreme needs all ``n`` prints.

A partition holds one row per (instrument, calendar slot): its size is bounded by the length of the
calendar, however many raw ticks an instrument has, because bars are aggregated before they get here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def keys_of(by: str | Keys) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def ordered(by: str | Keys, order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys_of(by)).orderBy(order)


def at(value: str | Column, back: int, by: str | Keys = "symbol", idx: str = "idx") -> Column:
    """Value ``back`` calendar slots ago (negative looks ahead)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(value).over(ordered(by, idx).rangeBetween(-back, -back))


def over_slots(agg: Column, first: int, last: int, by: str | Keys = "symbol", idx: str = "idx") -> Column:
    """``agg`` over the slots ``first..last`` relative to the row (both inclusive)."""
    return agg.over(ordered(by, idx).rangeBetween(first, last))


def full(agg: Column, value: str, n: int, first: int, last: int, by: str | Keys = "symbol", idx: str = "idx") -> Column:
    """Like :func:`over_slots`, NULL unless all ``n`` slots hold a value."""
    return F.when(over_slots(F.count(value), first, last, by, idx) == n, over_slots(agg, first, last, by, idx))


def running(agg: Column, by: str | Keys, order: str) -> Column:
    """``agg`` over everything up to and including the row."""
    return agg.over(ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def before(agg: Column, by: str | Keys, order: str) -> Column:
    """``agg`` over everything strictly before the row."""
    return agg.over(ordered(by, order).rowsBetween(Window.unboundedPreceding, -1))
