"""Shared calendar, densification and alignment of instruments to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``(idx, ts)``: every slot any instrument printed in, numbered from 0.

    One row per slot, so the single aggregated array is as long as the calendar and independent of
    the number of instruments or raw rows.
    """
    return df.agg(F.array_sort(F.collect_set(ts)).alias("slots")).select(F.posexplode("slots").alias("idx", ts))


def with_index(df: DataFrame, ts: str = "ts", slots: DataFrame | None = None) -> DataFrame:
    """Add ``idx``, the row's position in the shared calendar."""
    return df.join(calendar(df, ts) if slots is None else slots, ts)


def densify(df: DataFrame, by: str = "symbol", ts: str = "ts", slots: DataFrame | None = None) -> DataFrame:
    """One row per instrument and calendar slot; missing prints are NULL rows.

    Only for callers that want the padded grid itself: the other operators work on sparse rows.
    ``idx`` is the slot's position.  The calendar reaches the instruments as one array and is exploded per instrument, so there is
    no cartesian join; the data is then joined on (instrument, slot).
    """
    slots = calendar(df, ts) if slots is None else slots
    every_slot = slots.agg(F.array_sort(F.collect_list(F.struct("idx", ts)))).scalar()
    grid = df.select(by).distinct().select(by, F.inline(every_slot))
    return grid.join(df.drop("idx"), [by, ts], "left")


def interpolate_linear(df: DataFrame, value: str = "value", by: str = "symbol", order: str = "ts") -> DataFrame:
    """Fill NULLs on the straight line between their neighbours, by row position.

    Trailing NULLs keep the last value; leading NULLs stay.
    """
    w = Window.partitionBy(by).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next known row is the last one seen when reading backwards: frames that only grow are linear
    ahead = Window.partitionBy(by).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(value).alias("v")))
    step = df.withColumn("_pos", F.row_number().over(w))
    step = step.withColumn("_lo", F.last(known, ignorenulls=True).over(back)).withColumn(
        "_hi", F.last(known, ignorenulls=True).over(ahead)
    )
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col("_pos") - F.col("_lo.p")) / (
        F.col("_hi.p") - F.col("_lo.p")
    )
    filled = (
        F.when(F.col(value).isNotNull() | F.col("_lo").isNull(), F.col(value))
        .when(F.col("_hi").isNull(), F.col("_lo.v"))
        .otherwise(line)
    )
    return step.withColumn(value, filled).drop("_pos", "_lo", "_hi")


def align(
    series: DataFrame,
    target: DataFrame,
    by: str = "series_id",
    ts: str = "ts",
    value: str = "value",
    fill: str | None = "ffill",
    before: float | None = None,
) -> DataFrame:
    """Put each series on the slots of ``target``.

    ``target`` has ``ts`` (one calendar for all series) or ``(by, ts)``.  Values on slots absent from
    the target are dropped *before* filling, so an off-calendar value is lost, unlike in
    :func:`asof_join`.  ``fill='ffill'`` carries the last value; ``before`` stands in front of it.
    """
    if by in target.columns:
        grid = target.select(by, ts).distinct()
    else:
        slots = target.agg(F.array_sort(F.collect_set(ts))).scalar()
        grid = series.select(by).distinct().select(by, F.explode(slots).alias(ts))
    out = grid.join(series.select(by, ts, value), [by, ts], "left")
    if fill == "ffill":
        out = out.withColumn(value, fr.running(F.last(value, ignorenulls=True), by, ts))
    if before is not None:
        out = out.withColumn(value, F.coalesce(value, F.lit(before)))
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str | list[str],
    values: list[str],
    ts: str = "ts",
    right_ts: str | None = None,
    block: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Backward as-of join: for each left row the latest right row at or before it (``strict``: before).

    ``right`` holds at most one row per (by, ts).  The work is cut into time blocks (calendar months
    of ``ts`` unless ``block`` says otherwise): inside a block the two sides are interleaved and the
    last right row is carried down; across blocks only each block's last right row travels.  A
    window partition is thus one key *and one block*, so a key holding a large share of all rows
    still spreads over as many tasks as it has blocks.
    """
    by = fr.keys_of(by)
    right_ts = right_ts or ts
    block_of = F.trunc(F.col("_ts").cast("date"), "month") if block is None else block
    payload = F.struct(F.col(right_ts).alias("_ts"), *[F.col(v) for v in values])
    r = right.select(*by, F.col(right_ts).alias("_ts"), payload.alias("_hit")).withColumn("_block", block_of)
    l_cols = left.columns
    l = left.withColumn("_ts", F.col(ts)).withColumn("_block", block_of)

    last_of_block = r.groupBy(*by, "_block").agg(F.max_by("_hit", "_ts").alias("_last"))
    blocks = (
        last_of_block.select(*by, "_block", "_last")
        .unionByName(l.select(*by, "_block").distinct().withColumn("_last", F.lit(None).cast(last_of_block.schema["_last"].dataType)))
        .groupBy(*by, "_block")
        .agg(F.max("_last").alias("_last"))
    )
    carried = blocks.select(
        *by, "_block", fr.before(F.last("_last", ignorenulls=True), by, "_block").alias("_carried")
    ).where("_carried IS NOT NULL")

    # right rows go in front of left rows of the same instant, or behind them when strict
    right_side = F.lit(1 if strict else -1)
    both = l.withColumn("_side", F.lit(0)).unionByName(
        r.withColumn("_side", right_side), allowMissingColumns=True
    )
    w = (
        Window.partitionBy(*by, "_block")
        .orderBy("_ts", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = both.withColumn("_found", F.last("_hit", ignorenulls=True).over(w)).where("_side = 0")
    joined = local.join(carried, [*by, "_block"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return joined.select(*l_cols, F.col("_found._ts").alias("matched_ts"), *[F.col(f"_found.{v}").alias(v) for v in values])


def next_slot(df: DataFrame, slots: DataFrame, ts: str, alias: str = "next_ts") -> DataFrame:
    """First calendar slot strictly after the date ``ts`` (which need not be a slot itself).

    The distinct dates and the slots are laid on one line, cut by years; read backwards, the last slot seen
    is the next one.  What lies beyond a year's last slot is looked up among the years' first slots.
    """
    days = df.select(F.col(ts).alias("_d")).distinct().withColumn("_slot", F.lit(None).cast(slots.schema["ts"].dataType))
    line = days.unionByName(slots.select(F.col("ts").alias("_d"), F.col("ts").alias("_slot")))
    line = line.groupBy("_d").agg(F.max("_slot").alias("_slot")).withColumn("_y", F.year("_d"))
    back = Window.partitionBy("_y").orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    near = line.select(F.col("_d").alias(ts), "_y", F.last("_slot", ignorenulls=True).over(back).alias("_near"))
    # one row per calendar year
    years = line.groupBy("_y").agg(F.min("_slot").alias("_first"))
    later = Window.orderBy(F.desc("_y")).rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("_y", F.last("_first", ignorenulls=True).over(later).alias("_far"))
    found = near.join(years, "_y").select(ts, F.coalesce("_near", "_far").alias(alias))
    return df.join(found, ts)


def last_complete_period(df: DataFrame, today, by: str | None = None, label: str = "period_end") -> DataFrame:
    """Latest period whose calendar end has passed on ``today``, and whether a partial one follows."""
    today = F.lit(today).cast("date")
    done = F.max(F.when(F.col(label) <= today, F.col(label)))
    last = F.max(label)
    return df.groupBy(*([by] if by else [])).agg(
        F.coalesce(done, last).alias("last_period"), c.holds(last > today).alias("is_partial")
    )


def staleness_days(df: DataFrame, today, by: str | None = None, ts: str = "ts") -> DataFrame:
    """Age in days of the newest row."""
    return df.groupBy(*([by] if by else [])).agg(
        F.max(F.col(ts).cast("date")).alias("data_as_of"),
        F.datediff(F.lit(today).cast("date"), F.max(F.col(ts).cast("date"))).alias("days_stale"),
    )


def snap_to_period(requests: DataFrame, periods: DataFrame, ts: str = "ts", label: str = "period_end") -> DataFrame:
    """Latest period label at or before each requested date (a rebalance date that was picked freely)."""
    labels = periods.select(F.col(label).alias("_label")).distinct().withColumns({"_one": F.lit(0), label: F.col("_label")})
    found = asof_join(requests.withColumn("_one", F.lit(0)), labels, "_one", [label], ts, right_ts="_label")
    return found.drop("_one", "matched_ts")
