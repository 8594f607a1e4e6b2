"""Drawdown-triggered leverage tranches on top of a return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators.crossings import first_crossing, taken
from barloom.session import materialise


def leverage_tranches(
    rets: DataFrame,
    trigger1_pct: float = 7.0,
    leg1_pct: float = 50.0,
    trigger2_pct: float = 5.0,
    leg2_pct: float = 50.0,
    hold_mode: str = "fixed_months",
    hold: int = 6,
    recovery_pct: float = 0.0,
    by: str = "strategy_id",
) -> DataFrame:
    """Tranche log: ``(by, leg, trigger_no, period_return, start_no, end_no, leg_pct)``.

    Leg 1 opens after a return at or below ``-trigger1``; leg 2 after one at or below ``-trigger2``
    within the two periods following a leg-1 trigger, once per cycle.  At most one tranche per leg is
    active; a blocked leg 2 still uses up its cycle.  On one row leg 2 is tested before leg 1.  A
    tranche starts on the next row and ends ``hold`` rows after its trigger, or (``ath_recovery``) on
    the first row whose unlevered value is ``recovery_pct`` above the high at the trigger; both ends
    inclusive, cut at the series' end.  ``row_no`` counts the series' rows from 0.
    """
    if hold_mode not in ("fixed_months", "ath_recovery"):
        raise ValueError("hold_mode must be 'fixed_months' or 'ath_recovery'")
    w = fr.ordered(by, "period_no")
    last = F.count("*").over(Window.partitionBy(by)) - 1
    rows = rets.select(by, "period_no", "ret").withColumns({"idx": (F.row_number().over(w) - 1).cast("long"), "_last": last.cast("long")})
    if hold_mode == "ath_recovery":
        rows = rows.withColumn("_nav", fr.running(F.product(1.0 + F.col("ret")), by, "period_no"))
        high = fr.running(F.max("_nav"), by, "period_no")
        rows = materialise(rows.withColumn("_target", high * (1 + recovery_pct / 100.0)))
    falls = rows.where((F.col("ret") <= -min(trigger1_pct, trigger2_pct) / 100.0) & (F.col("idx") < F.col("_last")))
    if hold_mode == "ath_recovery":
        falls = first_crossing(falls, rows, [by], "_target", "_nav", True, hit="_end")
    else:
        falls = falls.withColumn("_end", F.col("idx") + hold)
    falls = materialise(falls.select(by, "idx", "ret", "_last", "_end"))
    # what a leg does is known for every trigger; which ones it takes is a chain that does not overlap
    first = taken(falls.where(F.col("ret") <= -trigger1_pct / 100.0), [by], "idx", "_end")
    first = materialise(first.withColumn("leg", F.lit(1)))
    near = F.explode(F.array(F.col("idx") + 1, F.col("idx") + 2)).alias("idx")
    again = falls.where(F.col("ret") <= -trigger2_pct / 100.0)
    # each cycle is used up by the first fall after it
    used = first.select(by, F.col("idx").alias("_cycle"), near).join(again.select(by, "idx"), [by, "idx"])
    used = used.groupBy(by, "_cycle").agg(F.min("idx").alias("idx")).select(by, "idx").distinct()
    second = taken(materialise(again.join(used, [by, "idx"], "left_semi")), [by], "idx", "_end").withColumn("leg", F.lit(2))
    end = F.least(F.coalesce("_end", "_last"), F.col("_last"))
    return first.unionByName(second).select(
        by,
        "leg",
        F.col("idx").cast("int").alias("trigger_no"),
        F.col("ret").alias("period_return"),
        (F.col("idx") + 1).cast("int").alias("start_no"),
        end.cast("int").alias("end_no"),
        F.when(F.col("leg") == 1, float(leg1_pct)).otherwise(float(leg2_pct)).alias("leg_pct"),
    )


def leverage_overlay(rets: DataFrame, tranches: DataFrame, annual_interest_pct: float = 10.0, by: str = "strategy_id") -> DataFrame:
    """Levered returns: adds ``lev_frac, leveraged_return, interest`` (interest per unit of start equity).

    Leverage is a fraction of current equity: ``r * (1 + lev) - lev * rate / 12``; equity at or below
    zero earns nothing.  Tranches are spelled out over their rows and joined on the row number.
    """
    numbered = rets.withColumn("row_no", F.row_number().over(fr.ordered(by, "period_no")) - 1)
    active = (
        tranches.select(by, F.explode(F.sequence("start_no", "end_no")).alias("row_no"), "leg_pct")
        .groupBy(by, "row_no")
        .agg((F.sum("leg_pct") / 100.0).alias("lev_frac"))
    )
    out = numbered.join(active, [by, "row_no"], "left").withColumn("lev_frac", F.coalesce("lev_frac", F.lit(0.0)))
    charge = F.col("lev_frac") * F.lit(annual_interest_pct / 100.0 / 12.0)
    out = out.withColumn("_lev_ret", F.col("ret") * (1 + F.col("lev_frac")) - charge)
    equity = F.coalesce(fr.before(F.product(1.0 + F.col("_lev_ret")), by, "period_no"), F.lit(1.0))
    return (
        out.withColumn("_equity", equity)
        .withColumn("interest", F.col("_equity") * charge)
        .withColumn("leveraged_return", F.when(F.col("_equity") > 0, F.col("_lev_ret")).otherwise(F.lit(0.0)))
        .drop("_equity", "_lev_ret")
    )


def leverage_summary(overlay: DataFrame, tranches: DataFrame, capital: float = 1_000_000.0, by: str = "strategy_id") -> DataFrame:
    """Interest in money and number of tranches."""
    cost = overlay.groupBy(by).agg((F.sum("interest") * capital).alias("total_interest"))
    count = tranches.groupBy(by).agg(F.count("*").alias("n_tranches"))
    return cost.join(count, by, "left").withColumn("n_tranches", F.coalesce("n_tranches", F.lit(0)))
