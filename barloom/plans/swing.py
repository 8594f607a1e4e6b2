"""Inputs of the per-instrument trading rules: bars, indicators and the universe in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators import leverage
from barloom.operators.ranking import assign_period
from barloom.session import materialise


def universe_bars(
    bars: DataFrame, universe: DataFrame, rule: str = "month_start", freq: str = "month"
) -> DataFrame:
    """Bars of every name a strategy's universe ever held, with ``entry_rank`` while it does.

    ``universe`` comes from :func:`barloom.operators.ranking.universe_calendar`; indicators are columns
    of ``bars`` already, computed over the whole history.  Names never ranked are dropped by a semi
    join before anything is multiplied by strategies; bars before a strategy's first universe are cut.
    The average-cross rule may queue an order on a slot its instrument did not print on: give it bars
    from :func:`barloom.operators.grid.densify`.
    """
    mine = bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    placed = assign_period(mine, universe, rule, freq=freq)
    ranks = universe.select("strategy_id", "symbol", F.col("period_no").alias("universe_no"), "entry_rank")
    traded = ranks.select("strategy_id", "symbol").distinct()
    rows = placed.where("universe_no IS NOT NULL").join(traded, ["strategy_id", "symbol"], "left_semi")
    return rows.join(ranks, ["strategy_id", "symbol", "universe_no"], "left")


def levered_equity(equity: DataFrame, capital: float = 1_000_000.0, annual_interest_pct: float = 10.0, **params) -> DataFrame:
    """What leverage on the monthly path of a trading rule's equity would have made of it, one row a strategy.

    ``equity(strategy_id, ts, equity)`` is any curve (:func:`barloom.operators.trades.equity_curve`); its last value of each month gives the returns that
    trigger tranches (``params`` of :func:`barloom.operators.leverage.leverage_tranches`).  Growth is annual over the days between the first and the
    last month's end; drawdowns are those of the monthly paths.  A curve within one month has no returns and gives no row.
    """
    by = "strategy_id"
    month = equity.where("equity IS NOT NULL").groupBy(by, c.period_no("ts").alias("period_no")).agg(F.max_by("equity", "ts").alias("equity"))
    w = fr.ordered(by, "period_no")
    month = month.withColumns({"ret": c.growth("equity", F.lag("equity").over(w)), "_high": fr.running(F.max("equity"), by, "period_no")})
    month = materialise(month)
    rets = month.where("ret IS NOT NULL").select(by, "period_no", "ret")
    tranches = materialise(leverage.leverage_tranches(rets, by=by, **params))
    path = leverage.leverage_overlay(rets, tranches, annual_interest_pct, by)
    path = path.withColumn("_lev", capital * fr.running(F.product(1.0 + F.col("leveraged_return")), by, "period_no"))
    path = path.withColumn("_lev_high", fr.running(F.max("_lev"), by, "period_no"))
    levered = path.groupBy(by).agg(
        F.max_by("_lev", "period_no").alias("levered_equity"),
        F.min(c.growth("_lev", "_lev_high")).alias("levered_drawdown"),
        (F.sum("interest") * capital).alias("total_interest"),
    )
    plain = month.groupBy(by).agg(
        F.max_by("equity", "period_no").alias("end_equity"),
        F.min(c.growth("equity", "_high")).alias("max_drawdown"),
        F.datediff(c.period_end_of(F.max("period_no")), c.period_end_of(F.min("period_no"))).alias("_days"),
    )
    count = tranches.groupBy(by).agg(F.count("*").alias("n_tranches"))
    years = F.col("_days") / 365.25
    rate = lambda end: F.when((F.col(end) > 0) & (years > 0), F.pow(F.col(end) / capital, 1 / years) - 1)
    out = plain.join(levered, by).join(count, by, "left")
    return out.select(
        by, "end_equity", rate("end_equity").alias("cagr"), "max_drawdown", "levered_equity", rate("levered_equity").alias("levered_cagr"),
        "levered_drawdown", "total_interest", F.coalesce("n_tranches", F.lit(0)).alias("n_tranches"),
    )
