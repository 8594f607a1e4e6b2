"""Rotation strategies between a handful of series, set-based, for any number of portfolios.

A portfolio is a row group keyed by ``portfolio_id``; all windows are partitioned by it, so one plan
runs many rotations and each partition is one calendar long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators.indicators import ema, own_trailing_return

KEY = "portfolio_id"


def rs_rotation(prices: DataFrame, legs: DataFrame, lookback: int = 55) -> tuple[DataFrame, DataFrame]:
    """Quarterly relative-strength rotation -> ``(daily returns, rebalance log)``.

    ``prices(series_id, ts, value)``; ``legs(portfolio_id, series_id, pos)`` with position 0 the
    reference and 1.. the candidates in order of preference.  On the first trading day of each quarter
    (from the reference's ``lookback``-th day) the candidate with the highest trailing return in excess
    of the reference's is held if that excess is positive, else the reference; trailing returns run on
    each series' own rows.  A choice earns from the next day.
    """
    trailing = own_trailing_return(prices, lookback).join(legs, "series_id")
    ref = trailing.where("pos = 0").select(KEY, "ts", F.col("trailing_return").alias("_ref"))
    days = legs.where("pos = 0").join(prices, "series_id").select(KEY, "ts")
    started = ref.where("_ref IS NOT NULL")
    rebalances = started.groupBy(KEY, c.period_no("ts", "quarter").alias("_q")).agg(F.min("ts").alias("ts")).drop("_q")

    scored = (
        trailing.where("pos > 0")
        .join(ref, [KEY, "ts"])
        .select(KEY, "ts", "series_id", "pos", (F.col("trailing_return") - F.col("_ref")).alias("rs"))
        .where("rs IS NOT NULL")
    )
    best = scored.groupBy(KEY, "ts").agg(F.max_by(F.struct("series_id", "rs"), F.struct("rs", -F.col("pos"))).alias("_b"))
    reference = legs.where("pos = 0").select(KEY, F.col("series_id").alias("_reference"))
    log = (
        rebalances.join(best, [KEY, "ts"], "left")
        .join(reference, KEY)
        .select(
            KEY,
            F.col("ts").alias("rebalance_date"),
            F.when(F.col("_b.rs") > 0, F.col("_b.series_id")).otherwise(F.col("_reference")).alias("chosen"),
            F.col("_b.rs").alias("best_rs"),
        )
    )
    held = _held_before(days, log.select(KEY, F.col("rebalance_date").alias("ts"), "chosen"))
    return held.join(_filled_returns(prices, legs, days), [KEY, "ts", "series_id"]).where("ret IS NOT NULL").select(
        KEY, "ts", F.col("series_id").alias("held"), "ret"
    ), log


def _held_before(days: DataFrame, choices: DataFrame) -> DataFrame:
    """Series in force on each day: the last choice made strictly before it."""
    marked = days.join(choices, [KEY, "ts"], "left")
    return marked.select(KEY, "ts", fr.before(F.last("chosen", ignorenulls=True), KEY, "ts").alias("series_id"))


def _filled_returns(prices: DataFrame, legs: DataFrame, days: DataFrame) -> DataFrame:
    """Returns of every leg on the portfolio's calendar, prices carried forward."""
    every = days.join(legs.select(KEY, "series_id"), KEY)
    filled = every.join(prices.select("series_id", "ts", "value"), ["series_id", "ts"], "left")
    part = [KEY, "series_id"]
    filled = filled.withColumn("value", fr.running(F.last("value", ignorenulls=True), part, "ts"))
    w = Window.partitionBy(*part).orderBy("ts")
    return filled.select(*part, "ts", "value", c.growth("value", F.lag("value").over(w)).alias("ret"))


def vote_rotation(
    spot: DataFrame,
    prices: DataFrame,
    legs: DataFrame,
    ema_long: int = 250,
    ema_short: int = 50,
    rs_lookback: int = 88,
    min_votes: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two-of-three vote between an equity leg and a defensive leg -> ``(returns, signal log, diagnostics)``.

    ``spot(series_id, ts, value)``; ``legs(portfolio_id, spot_id, equity_id, defensive_id)``.  Votes:
    spot above its long and its short average, equity's ``rs_lookback``-day return above the defensive
    leg's.  The vote of a month's last trading day decides; the first trading day of the next month
    executes; the new holding earns from the day after.  Before the return criterion exists the
    equity leg is held.  Averages run on the spot's own calendar and are then carried onto the
    equity leg's.
    """
    own = Window.partitionBy("series_id").orderBy("ts")
    rows = spot.withColumn("idx", F.row_number().over(own) - 1)
    averages = ema(rows, {"ema_long": ema_long, "ema_short": ema_short}, "value", "series_id").select(
        F.col("series_id").alias("spot_id"), "ts", F.col("value").alias("spot"), "ema_long", "ema_short"
    )
    days = legs.join(prices.select(F.col("series_id").alias("equity_id"), "ts"), "equity_id")
    on_cal = days.join(averages, ["spot_id", "ts"], "left")
    for x in ("spot", "ema_long", "ema_short"):
        on_cal = on_cal.withColumn(x, fr.running(F.last(x, ignorenulls=True), KEY, "ts"))
    for leg in ("equity", "defensive"):
        px = prices.select(F.col("series_id").alias(f"{leg}_id"), "ts", F.col("value").alias(leg))
        on_cal = on_cal.join(px, [f"{leg}_id", "ts"], "left").withColumn(
            leg, fr.running(F.last(leg, ignorenulls=True), KEY, "ts")
        )
    w = Window.partitionBy(KEY).orderBy("ts")
    d = on_cal.withColumns(
        {
            "_rs_e": c.growth("equity", F.lag("equity", rs_lookback).over(w)),
            "_rs_d": c.growth("defensive", F.lag("defensive", rs_lookback).over(w)),
            "_ret_e": c.growth("equity", F.lag("equity").over(w)),
            "_ret_d": c.growth("defensive", F.lag("defensive").over(w)),
        }
    )
    d = d.withColumns(
        {
            "above_long": c.holds(F.col("spot") > F.col("ema_long")),
            "above_short": c.holds(F.col("spot") > F.col("ema_short")),
            "stronger": c.holds(F.col("_rs_e") > F.col("_rs_d")),
            "_valid": F.col("_rs_e").isNotNull() & F.col("_rs_d").isNotNull(),
            "_month": c.period_no("ts", "month"),
        }
    )
    votes = sum((F.col(x).cast("int") for x in ("above_long", "above_short", "stronger")), F.lit(0))
    d = d.withColumn("votes", votes)

    # decision of the last day of the previous traded month meets the first day of this one
    decision = F.struct("ts", "votes", "above_long", "above_short", "stronger", "_valid")
    is_first = F.coalesce(F.lag("_month").over(w) < F.col("_month"), F.lit(False))
    d = d.withColumns({"_exec": is_first, "_dec": F.lag(decision).over(w)})
    target = F.when(
        F.col("_exec") & F.col("_dec._valid"),
        F.when(F.col("_dec.votes") >= min_votes, F.col("equity_id")).otherwise(F.col("defensive_id")),
    )
    d = d.withColumn("_target", target)
    d = d.withColumn("holding", F.coalesce(fr.running(F.last("_target", ignorenulls=True), KEY, "ts"), F.col("equity_id")))
    d = d.withColumn("_was", F.coalesce(F.lag("holding").over(w), F.col("equity_id")))

    returns = d.select(
        KEY, "ts", F.when(F.col("_was") == F.col("equity_id"), F.col("_ret_e")).otherwise(F.col("_ret_d")).alias("ret")
    ).where("ret IS NOT NULL")
    log = d.where("_target IS NOT NULL AND holding <> _was").select(
        KEY,
        F.col("ts").alias("exec_date"),
        F.col("_dec.ts").alias("decision_date"),
        F.col("holding").alias("position"),
        F.col("_dec.votes").alias("votes"),
        F.col("_dec.above_long").alias("above_long"),
        F.col("_dec.above_short").alias("above_short"),
        F.col("_dec.stronger").alias("stronger"),
    )
    diagnostics = d.select(
        KEY, "ts", "spot", "ema_long", "ema_short", "above_long", "above_short", "stronger", "votes", "holding"
    )
    return returns, log, diagnostics
