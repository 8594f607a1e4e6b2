"""Period grids: month, week, quarter; pairing of intraday bars; compounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr


def resample_last(df: DataFrame, freq: str = "month", value: str = "close", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Last non-null value per period: ``(by, period_end, period_no, price)``.

    One hash aggregation with map-side combine.  Empty periods have no row but keep their number.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(by, c.period_no(ts, freq).alias("period_no"))
        .agg(F.max_by(value, ts).alias("price"))
        .select(by, c.period_end_of("period_no", freq).alias("period_end"), "period_no", "price")
    )


def compound(df: DataFrame, ret: str, by: list[str], alias: str = "period_return") -> DataFrame:
    """``prod(1 + r) - 1`` within ``by``; NULL returns are skipped."""
    return df.groupBy(*by).agg((F.product(F.lit(1.0) + F.col(ret)) - 1.0).alias(alias))


def pair_bars(bars: DataFrame, n: int = 2, label: str = "last", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Merge ``n`` consecutive intraday bars, counted per day from the day's first bar.

    The count runs over the slots of *all* instruments of the day, so pairs line up across them.
    ``label`` names the merged bar after its first or last slot.
    """
    slots = bars.select(ts).distinct().withColumn("_day", F.to_date(ts))
    day = Window.partitionBy("_day").orderBy(ts)
    slots = slots.withColumn("_pair", F.floor((F.row_number().over(day) - 1) / n).cast("int"))
    edge = F.max(ts) if label == "last" else F.min(ts)
    slots = slots.withColumn("_label", edge.over(Window.partitionBy("_day", "_pair")))
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.col(ts)))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col(ts)))
    aggs = [first.alias("open")]
    if "high" in bars.columns:
        aggs += [F.max("high").alias("high"), F.min("low").alias("low")]
    aggs += [last.alias("close")]
    return bars.join(slots.drop("_day", "_pair"), ts).groupBy(by, F.col("_label").alias("ts")).agg(*aggs)


def period_edges(df: DataFrame, freq: str = "month", ts: str = "ts") -> DataFrame:
    """First and last trading slot of each period: ``(period_no, first_ts, last_ts)``."""
    return df.groupBy(c.period_no(ts, freq).alias("period_no")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def quarterly_rebalance_dates(df: DataFrame, min_start=None, ts: str = "ts") -> DataFrame:
    """First trading day of each quarter at or after ``min_start``."""
    days = df if min_start is None else df.where(F.col(ts) >= min_start)
    return days.groupBy(c.period_no(ts, "quarter").alias("quarter_no")).agg(F.min(ts).alias("rebalance_date"))


def month_execution(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Decision on a month's last trading day, execution on the next traded month's first one."""
    edges = period_edges(df, "month", ts)
    # one row per month of the calendar, hence a single tiny partition
    w = Window.partitionBy(F.lit(0)).orderBy("period_no")
    return edges.select(F.lag("last_ts").over(w).alias("decision_date"), F.col("first_ts").alias("exec_date")).where(
        "decision_date IS NOT NULL"
    )


def opening_range(bars: DataFrame, k: int, freq: str = "month", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """High and low of the first ``k`` slots of each period's first trading day, per instrument.

    Slots are counted over all instruments.  Instruments without a high and a low there have no range.
    """
    slots = bars.select(ts).distinct().withColumn("period_no", c.period_no(ts, freq)).withColumn("_day", F.to_date(ts))
    first_day = slots.groupBy("period_no").agg(F.min("_day").alias("_day"))
    opening = slots.join(first_day, ["period_no", "_day"], "left_semi")
    w = Window.partitionBy("period_no").orderBy(ts)
    opening = opening.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(ts, "period_no")
    return (
        bars.join(opening, ts)
        .groupBy("period_no", by)
        .agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"))
        .where("range_high IS NOT NULL AND range_low IS NOT NULL")
    )


def opening_bars(range_minutes: float) -> int:
    """Number of hourly bars in the opening range (halves round to even)."""
    return max(1, round(range_minutes / 60))


def find_gaps(df: DataFrame, days: int = 6, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Consecutive bars more than ``days`` (at least 1) apart: ``(by, gap_start, gap_end)``.

    A gap of a day or more never lies inside a day, so each instrument is first reduced to its
    days' first and last bar; the window then sees one row per day, not one per tick.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    daily = df.groupBy(by, F.to_date(ts).alias("_day")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    w = Window.partitionBy(by).orderBy("_day")
    gap = daily.select(by, F.lag("_last").over(w).alias("gap_start"), F.col("_first").alias("gap_end"))
    limit = F.make_dt_interval(F.lit(days))
    return gap.where(F.col("gap_end") - F.col("gap_start") > limit)


def backfill_windows(
    gaps: DataFrame, chunk_days: int = 90, pad_days: int = 1, start: str = "gap_start", end: str = "gap_end"
) -> DataFrame:
    """Cut each gap into request windows of at most ``chunk_days``, walking back from its end.

    ``pad_days`` widens the gap on both sides.  Adds ``request_no, from_ts, to_ts``.
    """
    day = F.make_dt_interval(F.lit(1))
    lo = F.col(start) - day * F.lit(pad_days)
    hi = F.col(end) + day * F.lit(pad_days)
    span = F.timestamp_diff("MICROSECOND", lo, hi)
    step = (chunk_days + 1) * 86_400 * 1_000_000
    count = F.ceil(span / F.lit(step)).cast("int")
    out = gaps.withColumns({"_lo": lo, "_hi": hi}).withColumn("_n", count).where("_n > 0")
    out = out.withColumn("request_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    to = F.col("_hi") - F.make_dt_interval(F.col("request_no") * (chunk_days + 1))
    out = out.withColumn("to_ts", to)
    frm = F.greatest(F.col("to_ts") - F.make_dt_interval(F.lit(chunk_days)), F.col("_lo"))
    return out.withColumn("from_ts", frm).drop("_lo", "_hi", "_n")


def last_bar_of_period(bars: DataFrame, freq: str = "month", ts: str = "ts") -> DataFrame:
    """Mark the calendar's last slot of each period with ``is_last_bar``."""
    edges = period_edges(bars, freq, ts).select("period_no", "last_ts")
    return (
        bars.withColumn("period_no", c.period_no(ts, freq))
        .join(edges, "period_no")
        .withColumn("is_last_bar", F.col(ts) == F.col("last_ts"))
        .drop("last_ts")
    )


def period_returns(
    panel: DataFrame, by: str = "symbol", gap: str = "drop", price: str = "price", idx: str = "period_no"
) -> DataFrame:
    """One-period return ``ret``.

    ``gap='drop'``: NULL unless the previous calendar period holds a price.  ``gap='pad'``: missing
    periods, and those without a price, carry the last price, so they appear as rows with a return of 0 and the first price after
    them is compared with the last one before.
    """
    if gap == "drop":
        return panel.withColumn("ret", c.growth(price, fr.at(price, 1, by, idx)))
    if gap != "pad":
        raise ValueError("gap must be 'drop' or 'pad'")
    w = Window.partitionBy(by).orderBy(idx)
    last = panel.agg(F.max(idx)).scalar()
    panel = panel.where(F.col(price).isNotNull())
    until = F.coalesce(F.lead(idx).over(w) - 1, last)
    return (
        panel.withColumn("ret", c.growth(price, F.lag(price).over(w)))
        .withColumn("_no", F.sequence(F.col(idx), until))
        .withColumn("_no", F.explode("_no"))
        .withColumn("ret", F.when(F.col("_no") > F.col(idx), F.lit(0.0)).otherwise(F.col("ret")))
        .withColumn(idx, F.col("_no"))
        .drop("_no")
    )
