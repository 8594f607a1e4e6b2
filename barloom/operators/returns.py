"""Period returns of holdings and the daily overlays that refine them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.operators.holdings import holding_changes, spells
from barloom.operators.resample import period_returns


def portfolio_returns(
    panel: DataFrame,
    holdings: DataFrame,
    schedule: DataFrame,
    periods: DataFrame,
    weighting: str = "equal",
    gold: DataFrame | None = None,
    gap: str = "drop",
    freq: str = "month",
) -> DataFrame:
    """``(strategy_id, period_end, period_no, ret)`` for every simulated period.

    Names picked at a rebalance earn from the next period through the next rebalance.  ``equal``: mean
    of the held names' returns, missing ones skipped.  ``drift``: share counts fixed at the rebalance,
    a missing price counts as zero value.  Gold spells earn the return of ``gold(period_no, value)``.
    Periods without a holding, and undefined returns, are 0.
    """
    last = panel.agg(F.max("period_no")).scalar()
    spell = spells(schedule, last)
    held = spell.where("regime = 'equity'").join(
        holdings.select("strategy_id", "rebalance_no", "symbol", "n_active"), ["strategy_id", "rebalance_no"]
    )
    if weighting == "equal":
        rets = period_returns(panel, gap=gap).select("symbol", "period_no", "ret")
        earned = (
            held.join(rets, ["symbol", "period_no"])
            .groupBy("strategy_id", "period_no")
            .agg(F.avg("ret").alias("ret"))
        )
    elif weighting == "drift":
        earned = _drift(panel, held)
    else:
        raise ValueError("weighting must be 'equal' or 'drift'")
    if gold is not None:
        rets = period_returns(gold.withColumn("_g", F.lit(1)), by="_g", price="value").select("period_no", "ret")
        in_gold = spell.where("regime = 'gold'").join(rets, "period_no").select("strategy_id", "period_no", "ret")
        earned = earned.unionByName(in_gold)
    return periods.join(earned, ["strategy_id", "period_no"], "left").select(
        "strategy_id",
        c.period_end_of("period_no", freq).alias("period_end"),
        "period_no",
        F.coalesce("ret", F.lit(0.0)).alias("ret"),
    )


def _drift(panel: DataFrame, held: DataFrame) -> DataFrame:
    """Value of the basket relative to its rebalance, then its period-to-period change."""
    price = panel.select("symbol", "period_no", "price")
    base = price.select("symbol", F.col("period_no").alias("rebalance_period"), F.col("price").alias("_base"))
    value = (
        held.join(base, ["symbol", "rebalance_period"], "left")
        .join(price, ["symbol", "period_no"], "left")
        .groupBy("strategy_id", "rebalance_no", "period_no")
        .agg(
            (
                F.sum(F.coalesce(F.when(F.col("_base") > 0, c.ratio("price", "_base")), F.lit(0.0)))
                / F.max("n_active")
            ).alias("_v")
        )
    )
    w = Window.partitionBy("strategy_id", "rebalance_no").orderBy("period_no")
    return value.select(
        "strategy_id", "period_no", c.growth("_v", F.coalesce(F.lag("_v").over(w), F.lit(1.0))).alias("ret")
    )


def _daily_by_spell(bars: DataFrame, names: DataFrame, freq: str) -> DataFrame:
    """Daily rows of the names of each spell: equi-join on (symbol, period number)."""
    day = bars.select("symbol", "ts", "open", "close", c.period_no("ts", freq).alias("period_no"))
    return names.join(day, ["symbol", "period_no"])


def _compound_spells(daily: DataFrame, spell: DataFrame) -> DataFrame:
    """Add up the slots' contributions per day, compound the days per period; idle periods earn 0."""
    per_day = daily.groupBy("strategy_id", "period_no", "ts").agg(F.sum("contribution").alias("r"))
    per_period = per_day.groupBy("strategy_id", "period_no").agg((F.product(1.0 + F.col("r")) - 1.0).alias("ret"))
    return (
        spell.select("strategy_id", "period_no")
        .distinct()
        .join(per_period, ["strategy_id", "period_no"], "left")
        .withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    )


def stoploss_overlay(
    panel: DataFrame,
    bars: DataFrame,
    holdings: DataFrame,
    schedule: DataFrame,
    stoploss_pct: float = 10.0,
    max_reentries: int = 0,
    freq: str = "month",
) -> DataFrame:
    """Recompute equity periods with a per-slot stop on daily closes and re-entry at the next open.

    Each slot is independent: bought at the rebalance price, stopped at a close at or below
    ``entry * (1 - pct)``, re-armed by a close above the *original* entry while re-entries are left,
    re-entered at the following bar's open (a re-entry into a missing open is lost), with a fresh stop
    from the price paid.  The slot machine is one ``aggregate`` over the slot's bars of one spell (a
    few dozen), so slots of all strategies run in parallel and inside the JVM.
    Output ``(strategy_id, period_no, ret)``.
    """
    last = bars.agg(F.max(c.period_no("ts", freq))).scalar()
    spell = spells(schedule, last).where("regime = 'equity'")
    entry = panel.select("symbol", F.col("period_no").alias("rebalance_period"), F.col("price").alias("entry"))
    slots = spell.join(holdings.select("strategy_id", "rebalance_no", "symbol", "n_active"), ["strategy_id", "rebalance_no"])
    slots = slots.join(entry.where("entry > 0"), ["symbol", "rebalance_period"])
    daily = _daily_by_spell(bars.where("close IS NOT NULL"), slots, freq)
    keys = ["strategy_id", "rebalance_no", "symbol", "n_active", "entry"]
    path = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "period_no", "close", "open"))).alias("_p"))

    keep = 1 - stoploss_pct / 100.0
    start = F.struct(
        F.col("entry").alias("paid"),
        F.col("entry").alias("prev"),
        F.lit(True).alias("inside"),
        F.lit(False).alias("armed"),
        F.lit(0).alias("used"),
        F.array().cast(f"array<struct<ts:{bars.schema['ts'].dataType.simpleString()},period_no:int,r:double>>").alias("out"),
    )

    def step(s, p):
        can_open = s["armed"] & c.holds(p["open"] > 0)
        was_in = s["inside"] & ~s["armed"]
        r = (
            F.when(can_open, c.growth(p["close"], p["open"]))
            .when(was_in & (s["prev"] > 0), c.growth(p["close"], s["prev"]))
            .otherwise(F.lit(0.0))
        )
        stopped = was_in & (p["close"] <= s["paid"] * keep)
        arm = ~s["armed"] & ~s["inside"] & (s["used"] < max_reentries) & (p["close"] > F.col("entry"))
        return F.struct(
            F.when(can_open, p["open"]).otherwise(s["paid"]).alias("paid"),
            F.when(s["armed"] & ~can_open, s["prev"]).otherwise(p["close"]).alias("prev"),
            F.when(can_open, F.lit(True)).when(stopped, F.lit(False)).otherwise(s["inside"]).alias("inside"),
            arm.alias("armed"),
            (s["used"] + arm.cast("int")).alias("used"),
            F.array_append(
                s["out"], F.struct(p["ts"].alias("ts"), p["period_no"].alias("period_no"), r.alias("r"))
            ).alias("out"),
        )

    moves = path.select("strategy_id", "n_active", F.inline(F.aggregate("_p", start, step)["out"]))
    return _compound_spells(moves.withColumn("contribution", F.col("r") / F.col("n_active")), spell)


def execution_lag_overlay(
    panel: DataFrame, bars: DataFrame, holdings: DataFrame, schedule: DataFrame, freq: str = "month"
) -> DataFrame:
    """Recompute the spells whose holdings changed as if traded at the next day's open.

    Dropped names earn the way from the rebalance price to that open, added names start at it,
    survivors run close to close; everything weighs 1/n of the new basket.  After a gold spell all
    names count as added.  Three set-based branches over the same daily rows, no fold.
    """
    last = bars.agg(F.max(c.period_no("ts", freq))).scalar()
    spell = spells(schedule, last).where("regime = 'equity'")
    changes = holding_changes(holdings, schedule).select("strategy_id", "rebalance_no", "symbol", "action")
    size = holdings.where("regime = 'equity'").groupBy("strategy_id", "rebalance_no").agg(F.max("n_active").alias("n"))
    touched = spell.join(changes.select("strategy_id", "rebalance_no").distinct(), ["strategy_id", "rebalance_no"], "left_semi")
    touched = touched.join(size, ["strategy_id", "rebalance_no"])

    names = holdings.where("regime = 'equity'").select("strategy_id", "rebalance_no", "symbol")
    names = names.join(changes.where("action = 'entry'"), ["strategy_id", "rebalance_no", "symbol"], "left").withColumn(
        "kind", F.when(F.col("action") == "entry", "added").otherwise("kept")
    )
    # names leaving for gold get no next-open leg: gold spells are not touched
    left = changes.where("action = 'exit'").withColumn("kind", F.lit("dropped"))
    names = names.drop("action").unionByName(left.drop("action"))

    first_day = bars.groupBy(c.period_no("ts", freq).alias("period_no")).agg(F.min("ts").alias("_d"))
    exec_day = (
        touched.join(first_day, "period_no").groupBy("strategy_id", "rebalance_no").agg(F.min("_d").alias("exec_ts"))
    )
    price = panel.select("symbol", F.col("period_no").alias("rebalance_period"), F.col("price").alias("last_price"))
    legs = (
        touched.join(exec_day, ["strategy_id", "rebalance_no"])
        .join(names, ["strategy_id", "rebalance_no"])
        .join(price, ["symbol", "rebalance_period"], "left")
    )
    daily = _daily_by_spell(bars, legs, freq)
    on_exec = F.col("ts") == F.col("exec_ts")
    opens = on_exec & (F.col("open") > 0)

    dropped = daily.where((F.col("kind") == "dropped") & opens & (F.col("last_price") > 0)).withColumn(
        "r", c.growth("open", "last_price")
    )
    running = daily.where((F.col("kind") != "dropped") & F.col("close").isNotNull())
    w = Window.partitionBy("strategy_id", "rebalance_no", "symbol").orderBy("ts")
    begin = F.when(F.col("kind") == "kept", F.col("last_price")).when(opens, F.col("open"))
    running = running.withColumns(
        {"_prev": F.coalesce(F.lag("close").over(w), begin), "_begin": F.first(begin).over(w)}
    ).where("_begin > 0")
    running = running.withColumn("r", F.when(F.col("_prev") > 0, c.growth("close", "_prev")).otherwise(F.lit(0.0)))
    cols = ["strategy_id", "period_no", "ts", (F.col("r") / F.col("n")).alias("contribution")]
    return _compound_spells(dropped.select(*cols).unionByName(running.select(*cols)), touched)


def merge_overlays(base: DataFrame, *overlays: DataFrame) -> DataFrame:
    """Replace base returns where an overlay recomputed the period; later overlays win."""
    out = base
    for i, overlay in enumerate(overlays):
        out = out.join(
            overlay.select("strategy_id", "period_no", F.col("ret").alias(f"_o{i}")), ["strategy_id", "period_no"], "left"
        )
    picks = [F.col(f"_o{i}") for i in reversed(range(len(overlays)))]
    return out.withColumn("ret", F.coalesce(*picks, "ret")).select(base.columns)
