"""Per-instrument indicators.  Inputs carry ``idx`` (see :mod:`barloom.operators.grid`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.functions.scan import linear_scan

#: Returns are annualised with twelve periods per year on every grid.
PERIODS_PER_YEAR = 12.0


def momentum(panel: DataFrame, lookback: int, skip: int, by: str = "symbol", idx: str = "period_no") -> DataFrame:
    """Return over ``lookback`` periods that ended ``skip`` periods ago -> ``score``."""
    end, start = fr.at("price", skip, by, idx), fr.at("price", skip + lookback, by, idx)
    return panel.withColumn("score", F.when((start > 0) & (end > 0), c.growth(end, start)))


def trailing_volatility(panel: DataFrame, lookback: int, skip: int, by: str = "symbol", idx: str = "period_no") -> DataFrame:
    """Annualised deviation of the one-period returns of the momentum window -> ``volatility``."""
    out = panel.withColumn("_r", c.growth("price", fr.at("price", 1, by, idx)))
    dev = fr.over_slots(F.stddev_samp("_r"), 1 - skip - lookback, -skip, by, idx)
    return out.withColumn("volatility", dev * F.sqrt(F.lit(PERIODS_PER_YEAR))).drop("_r")


def trailing_high(
    daily: DataFrame, asof: DataFrame, days: int = 365, value: str = "close", by: str = "symbol", label: str = "period_end"
) -> DataFrame:
    """Highest value of the ``days`` calendar days strictly before each ``(by, label)`` row of ``asof``.

    Daily rows are reduced to monthly maxima.  A date takes the maxima of the months that lie wholly in its span and
    the single days of the first and the last one: equi-joins on (instrument, month), which also split a hot instrument.
    """
    day = F.col("ts").cast("date")
    rows = daily.where(F.col(value).isNotNull()).select(by, day.alias("_day"), F.trunc(day, "month").alias("_m"), F.col(value).alias("_v"))
    asked = asof.select(by, label).distinct()
    first, last = F.date_sub(label, days), F.date_sub(label, 1)
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    spread = asked.select(by, label, first.alias("_first"), last.alias("_last"), F.explode(months).alias("_m"))
    whole = (F.col("_m") >= F.col("_first")) & (F.last_day("_m") <= F.col("_last"))
    maxima = rows.groupBy(by, "_m").agg(F.max("_v").alias("_v"))
    inner = spread.where(whole).join(maxima, [by, "_m"]).select(by, label, "_v")
    edges = spread.where(~whole).join(rows, [by, "_m"]).where("_day BETWEEN _first AND _last").select(by, label, "_v")
    high = inner.unionByName(edges).groupBy(by, label).agg(F.max("_v").alias("high_52w"))
    return asked.join(high, [by, label], "left")


def previous_close(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Close of the previous calendar slot -> ``prev_close``."""
    return bars.withColumn("prev_close", fr.at("close", 1, by))


def channel(bars: DataFrame, entry_lookback: int = 20, exit_lookback: int = 1, by: str = "symbol") -> DataFrame:
    """Highest high / lowest low of the preceding slots -> ``upper``, ``lower`` (all slots must print)."""
    return bars.withColumns(
        {
            "upper": fr.full(F.max("high"), "high", entry_lookback, -entry_lookback, -1, by),
            "lower": fr.full(F.min("low"), "low", exit_lookback, -exit_lookback, -1, by),
        }
    )


def ema(
    bars: DataFrame, spans: dict[str, int], value: str = "close", by: str = "symbol", idx: str = "idx"
) -> DataFrame:
    """Exponential averages ``{output column: span}``; ``y0 = x0``, weights decay through calendar gaps.

    After ``g`` slots the old average weighs ``(1-a)^g`` against ``a`` for the new value (the two are
    normalised), so only printed rows need to be visited.
    """
    x, i = F.col(value), F.col(idx)
    printed = F.when(x.isNotNull(), i)
    gap = i - fr.before(F.max(printed), by, idx)
    rows = bars.withColumn("_gap", gap)
    steps = {}
    for name, n in spans.items():
        a = 2.0 / (n + 1.0)
        old = F.coalesce(F.pow(F.lit(1.0 - a), F.col("_gap")), F.lit(0.0))
        weight = F.when(F.col("_gap").isNull(), F.lit(1.0)).otherwise(F.lit(a))
        steps[name] = (old / (old + weight), weight * x / (old + weight))
    out = linear_scan(rows, by, idx, steps)
    begun = fr.running(F.count(value), by, idx) > 0
    return out.withColumns({name: F.when(begun, F.col(name)) for name in spans}).drop("_gap")


def rsi(bars: DataFrame, period: int = 14, value: str = "close", by: str = "symbol", idx: str = "idx") -> DataFrame:
    """Wilder's relative strength -> ``rsi``.

    It is 100 where the average loss is zero *or not yet defined* (fewer than ``period`` changes), so
    the first defined reading can count as a cross from above.  A change across a calendar gap is
    undefined and leaves the averages as they were.
    """
    a, x, i = 1.0 / period, F.col(value), F.col(idx)
    last = fr.before(F.last(F.when(x.isNotNull(), F.struct(i.alias("i"), x.alias("x"))), ignorenulls=True), by, idx)
    rows = bars.withColumn("_last", last)
    rows = rows.withColumn("_change", F.when(i - F.col("_last.i") == 1, x - F.col("_last.x")))
    changed = F.when(F.col("_change").isNotNull(), i)
    rows = rows.withColumns(
        {"_gap": i - fr.before(F.max(changed), by, idx), "_seen": fr.running(F.count("_change"), by, idx)}
    )
    old = F.coalesce(F.pow(F.lit(1.0 - a), F.col("_gap")), F.lit(0.0))
    weight = F.when(F.col("_gap").isNull(), F.lit(1.0)).otherwise(F.lit(a))
    part = lambda side: (old / (old + weight), weight * F.greatest(side, F.lit(0.0)) / (old + weight))
    known = F.col("_change").isNotNull()
    steps = {"_gain": F.col("_change"), "_loss": -F.col("_change")}
    out = linear_scan(rows, by, idx, {n: tuple(F.when(known, v) for v in part(side)) for n, side in steps.items()})
    index = 100.0 - 100.0 / (1.0 + F.col("_gain") / F.col("_loss"))
    defined = (F.col("_seen") >= period) & (F.col("_loss") > 0)
    return out.withColumn("rsi", F.when(defined, index).otherwise(F.lit(100.0))).drop("_last", "_change", "_gap", "_seen", *steps)


def fresh_cross(bars: DataFrame, value: str = "rsi", threshold: float = 31.0, by: str = "symbol", idx: str = "idx") -> DataFrame:
    """True where ``value`` reaches ``threshold`` from below since the instrument's previous row."""
    prev = F.lag(value).over(fr.ordered(by, idx))
    return bars.withColumn("crossed", c.holds((F.col(value) >= threshold) & (prev < threshold)))


def own_trailing_return(series: DataFrame, n: int, value: str = "value", by: str = "series_id", ts: str = "ts") -> DataFrame:
    """Return over ``n`` rows of the instrument's own history -> ``trailing_return``."""
    w = Window.partitionBy(by).orderBy(ts)
    return series.withColumn("trailing_return", c.growth(value, F.lag(value, n).over(w)))


def relative_return(series: DataFrame, periods: list[int], value: str = "value", by: str = "series_id", idx: str = "period_no") -> DataFrame:
    """Trailing returns over several horizons -> ``trail_<n>`` (calendar periods, NULL across gaps)."""
    return series.withColumns({f"trail_{n}": c.growth(value, fr.at(value, n, by, idx)) for n in periods})


def next_open(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Open of the next calendar slot -> ``next_open``; NULL when the instrument does not open there."""
    return bars.withColumn("next_open", F.when(fr.at("open", -1, by) > 0, fr.at("open", -1, by)))
