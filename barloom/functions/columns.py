"""Column expressions with the null rules of the library.

Missing is NULL, never NaN; division by zero is NULL; a predicate over NULL is false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """``a / b`` with NULL for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def growth(a, b) -> Column:
    """``a / b - 1``."""
    return ratio(a, b) - F.lit(1.0)


def holds(condition: Column) -> Column:
    """A mask: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def no_nan(c) -> Column:
    """NaN and the infinities become NULL (done once, at ingest)."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def half_up(c) -> Column:
    """Whole quantity, halves rounded up."""
    return F.floor(_col(c) + F.lit(0.5))


def clip(c, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def elapsed_days(end, start) -> Column:
    """Whole 24-hour periods between two wall-clock times (floored, not calendar days)."""
    seconds = F.timestamp_diff("SECOND", _ntz(start), _ntz(end))
    return F.floor(seconds / F.lit(86400)).cast("int")


def normalize_name(c) -> Column:
    """Company name in the form names are compared in."""
    s = F.upper(F.coalesce(_col(c), F.lit("")))
    s = F.replace(s, F.lit("&"), F.lit(" AND "))
    s = F.regexp_replace(s, r"[.\-,()']", " ")
    s = F.regexp_replace(s, r"\b(LIMITED|LTD)\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (interpreted lambdas share no subexpressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def zone_label(rank, top_n: int, exit_rank: int) -> Column:
    """Buy / hold / out by rank."""
    rank = _col(rank)
    return (
        F.when(rank <= top_n, F.lit("Buy zone"))
        .when(rank <= exit_rank, F.lit("Hold zone"))
        .otherwise(F.lit("Out"))
    )


# -- calendar periods -------------------------------------------------------------------------

#: Grids a panel can be resampled to.
FREQS = ("month", "week", "quarter", "year")


def period_end(ts, freq: str = "month") -> Column:
    """Calendar label of the period holding ``ts``: its last day (weeks end on Friday)."""
    day = _col(ts).cast("date")
    if freq == "month":
        return F.last_day(day)
    if freq == "week":
        return F.next_day(F.date_sub(day, 1), "Fri")
    if freq == "quarter":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    if freq == "year":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    raise ValueError(f"freq must be one of {FREQS}")


def period_no(ts, freq: str = "month") -> Column:
    """Consecutive integer of the period holding ``ts``.

    Calendar periods are evenly numbered by arithmetic alone, so an empty period still takes a
    number and no dense grid has to be built to count periods.
    """
    day = _col(ts).cast("date")
    if freq == "month":
        return (F.year(day) * 12 + F.month(day) - 1).cast("int")
    if freq == "week":
        return F.floor((F.unix_date(period_end(day, "week")) - 1) / 7).cast("int")
    if freq == "quarter":
        return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")
    if freq == "year":
        return F.year(day).cast("int")
    raise ValueError(f"freq must be one of {FREQS}")


def period_end_of(no, freq: str = "month") -> Column:
    """Label of a period number; inverse of :func:`period_no`."""
    no = _col(no)
    if freq == "month":
        return F.last_day(F.make_date(F.floor(no / 12).cast("int"), (no % 12 + 1).cast("int"), F.lit(1)))
    if freq == "week":
        return F.date_from_unix_date((no * 7 + 1).cast("int"))
    if freq == "quarter":
        first = F.make_date(F.floor(no / 4).cast("int"), ((no % 4) * 3 + 1).cast("int"), F.lit(1))
        return F.last_day(F.add_months(first, 2))
    if freq == "year":
        return F.make_date(no.cast("int"), F.lit(12), F.lit(31))
    raise ValueError(f"freq must be one of {FREQS}")


def wall_clock_to_instant(ts) -> Column:
    """A TIMESTAMP_NTZ read as UTC, whatever the session zone (event time needs TIMESTAMP)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), _col(ts))
    return F.timestamp_micros(micros)


def instant_to_wall_clock(ts) -> Column:
    """Inverse of :func:`wall_clock_to_instant`."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ntz(c) -> Column:
    return _col(c).cast("timestamp_ntz")
