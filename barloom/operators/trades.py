"""Trades: from holdings, from signals, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators import grid
from barloom.operators.holdings import holding_changes


def trade_log(
    panel: DataFrame,
    rets: DataFrame,
    holdings: DataFrame,
    schedule: DataFrame,
    n: int = 30,
    capital: float = 1_000_000.0,
    freq: str = "month",
) -> DataFrame:
    """Discrete buys and sells behind a holdings history.

    A position is bought when a name enters, at the period price, for 1/n_active of the gross value,
    in whole units (halves up), and sold at the period price of the rebalance that drops it.  An entry
    without a price or value is never opened, an exit without a price gives no trade; names still held
    are marked at their last price (``status='open'``).
    """
    changes = holding_changes(holdings, schedule)
    w = Window.partitionBy("strategy_id", "symbol").orderBy("rebalance_no", F.desc("action"))
    islands = (
        changes.withColumn("_exit_no", F.lead("period_no").over(w))
        .where("action = 'entry'")
        .select("strategy_id", "symbol", "rebalance_no", F.col("period_no").alias("entry_no"), F.col("_exit_no").alias("exit_no"))
    )
    active = holdings.where("regime = 'equity'").groupBy("strategy_id", "rebalance_no").agg(F.max("n_active").alias("n_active"))
    nav = rets.select("strategy_id", "period_no", fr.running(F.product(1.0 + F.col("ret")), "strategy_id", "period_no").alias("nav"))
    nav = nav.withColumn("entry_no", F.col("period_no"))
    islands = islands.join(active, ["strategy_id", "rebalance_no"], "left").withColumn("n_active", F.coalesce("n_active", F.lit(n)))
    islands = grid.asof_join(
        islands, nav, "strategy_id", ["nav"], ts="entry_no", block=F.floor(F.col("_ts") / 12)
    ).drop("matched_ts")
    price = panel.select("symbol", "period_no", "price")
    entry = price.select("symbol", F.col("period_no").alias("entry_no"), F.col("price").alias("entry_price"))
    exit_ = price.select("symbol", F.col("period_no").alias("exit_no"), F.col("price").alias("_exit_price"))
    last = panel.groupBy("symbol").agg(F.max_by("price", "period_no").alias("_last_price"))
    end = panel.agg(F.max("period_no")).scalar()
    t = (
        islands.join(entry, ["symbol", "entry_no"])
        .join(exit_, ["symbol", "exit_no"], "left")
        .join(last, "symbol")
        .where("nav IS NOT NULL AND (exit_no IS NULL OR _exit_price IS NOT NULL)")
        .withColumn("status", F.when(F.col("exit_no").isNull(), "open").otherwise("closed"))
        .withColumn("exit_price", F.coalesce("_exit_price", "_last_price"))
        .withColumn("qty", c.half_up(F.col("nav") / F.col("n_active") * capital / F.col("entry_price")))
    )
    day = lambda no: c.period_end_of(no, freq)
    return t.select(
        "strategy_id",
        "symbol",
        day("entry_no").alias("entry_date"),
        "entry_price",
        F.when(F.col("exit_no").isNotNull(), day("exit_no")).alias("exit_date"),
        "exit_price",
        "qty",
        (F.col("qty") * (F.col("exit_price") - F.col("entry_price"))).alias("pnl"),
        c.growth("exit_price", "entry_price").alias("pnl_pct"),
        F.datediff(day(F.coalesce("exit_no", end)), day("entry_no")).alias("hold_days"),
        "status",
    )


# -- sizing and measures of single trades --------------------------------------------------------


def size_by_risk(
    trades: DataFrame,
    capital: float = 1_000_000.0,
    risk_pct: float = 1.0,
    max_position_pct: float = 20.0,
    min_stop_pct: float = 0.0,
) -> DataFrame:
    """Units such that the stop costs ``risk_pct`` of capital, capped at ``max_position_pct`` of it.

    The stop distance counts as at least ``min_stop_pct`` of the entry.  Adds ``qty, risked``.
    """
    dist = F.greatest(
        F.abs(F.col("entry_price") - F.col("stop_price")), F.col("entry_price") * F.lit(min_stop_pct / 100.0)
    )
    qty = F.least(
        c.ratio(F.lit(capital * risk_pct / 100.0), dist),
        c.ratio(F.lit(capital * max_position_pct / 100.0), F.col("entry_price")),
    )
    return trades.withColumn("qty", qty).withColumn("risked", F.col("qty") * dist)


def size_by_slot(trades: DataFrame, capital: float = 2_000_000.0, slots: int = 10, min_stop_pct: float = 1.0) -> DataFrame:
    """An equal share of capital per slot; the stop distance only measures the risk."""
    return size_by_share(trades, capital, 100.0 / slots, min_stop_pct)


def size_by_share(trades: DataFrame, capital: float = 1_000_000.0, position_pct: float = 5.0, min_stop_pct: float = 0.0) -> DataFrame:
    """A fixed share of capital per trade."""
    dist = F.greatest(
        F.abs(F.col("entry_price") - F.col("stop_price")), F.col("entry_price") * F.lit(min_stop_pct / 100.0)
    )
    qty = c.ratio(F.lit(capital * position_pct / 100.0), F.col("entry_price"))
    return trades.withColumn("qty", qty).withColumn("risked", F.col("qty") * dist)


def trade_measures(trades: DataFrame, short: bool = False, last_ts=None) -> DataFrame:
    """Adds ``pnl, pnl_pct, r_multiple, hold_days``; needs ``qty, risked``.

    Open trades are held until ``last_ts``.  Holding time counts whole 24-hour periods.
    """
    move = F.col("exit_price") - F.col("entry_price")
    pct = c.growth("exit_price", "entry_price")
    out = trades.withColumns(
        {
            "pnl": F.col("qty") * (-move if short else move),
            "pnl_pct": -pct if short else pct,
        }
    )
    until = F.coalesce("exit_date", last_ts) if last_ts is not None else F.col("exit_date")
    return out.withColumns(
        {
            "r_multiple": F.when(F.col("risked") > 0, F.col("pnl") / F.col("risked")),
            "hold_days": c.elapsed_days(until, "entry_date"),
        }
    )


def equity_curve(trades: DataFrame, bars: DataFrame, capital: float = 1_000_000.0, short: bool = False) -> DataFrame:
    """Capital plus realised and unrealised profit on every slot of ``bars``.

    A trade is spread over the slots it is held, from its entry on and before its exit, and meets its instrument's bars there
    in an equi-join, so only bars that are held are looked at.  A trade whose instrument does not print on a slot is
    worth its entry price there.
    """
    sign = -1.0 if short else 1.0
    t = trades.select("strategy_id", "symbol", "entry_date", "exit_date", "entry_price", "qty", "pnl", "status")
    slots = bars.agg(F.array_sort(F.collect_set("ts"))).scalar()
    held = lambda x: (x >= F.col("entry_date")) & (F.col("exit_date").isNull() | (x < F.col("exit_date")))
    spread = t.withColumn("_slots", slots).withColumn("ts", F.explode(F.filter("_slots", held))).drop("_slots")
    live = spread.join(bars.where("close IS NOT NULL").select("symbol", "ts", "close"), ["symbol", "ts"])
    floating = live.groupBy("strategy_id", "ts").agg(
        F.sum(F.lit(sign) * F.col("qty") * (F.col("close") - F.col("entry_price"))).alias("_floating")
    )
    realised = (
        t.where("status = 'closed'").groupBy("strategy_id", F.col("exit_date").alias("ts")).agg(F.sum("pnl").alias("_realised"))
    )
    every = t.select("strategy_id").distinct().select("strategy_id", F.explode(slots).alias("ts"))
    path = every.join(realised, ["strategy_id", "ts"], "left").join(floating, ["strategy_id", "ts"], "left")
    booked = fr.running(F.sum(F.coalesce("_realised", F.lit(0.0))), "strategy_id", "ts")
    return path.select(
        "strategy_id", "ts", (F.lit(capital) + booked + F.coalesce("_floating", F.lit(0.0))).alias("equity")
    )


def pair_trades(signals: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Pair entry and exit signals: an entry while flat opens, the first later exit closes.

    ``signals(by, ts, price, enter, leave)``; on one row the exit is seen before the entry.  Output
    ``(by, entry_date, entry_price, exit_date, exit_price, status)``; a trade still open has no exit.
    """

    w = Window.partitionBy(*by).orderBy(ts)
    rows = signals.select(
        *by, ts, F.col("price").cast("double").alias("price"), c.holds(F.col("enter")).alias("enter"), c.holds(F.col("leave")).alias("leave")
    ).where("enter OR leave")
    # a row with an entry leaves a position behind, one with only an exit leaves none
    held = F.coalesce(F.lag("enter").over(w), F.lit(False))
    rows = rows.select(
        *by, ts, "price", (F.col("enter") & (~held | F.col("leave"))).alias("opens"), (F.col("leave") & held).alias("closes")
    ).where("opens OR closes")
    after = F.lead(F.struct(ts, "price")).over(w)
    rows = rows.withColumn("_exit", after).where("opens")
    return rows.select(
        *by,
        F.col(ts).alias("entry_date"),
        F.col("price").alias("entry_price"),
        F.col(f"_exit.{ts}").alias("exit_date"),
        F.col("_exit.price").alias("exit_price"),
        F.when(F.col("_exit").isNull(), "open").otherwise("closed").alias("status"),
    )
