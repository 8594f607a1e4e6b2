"""Performance tables of return series keyed by ``by``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr


def equity_path(rets: DataFrame, by: str = "strategy_id", ret: str = "ret", ts: str = "period_end") -> DataFrame:
    """Growth of 1, running high and drawdown -> ``cum, peak, drawdown``."""
    cum = rets.withColumn("cum", fr.running(F.product(1.0 + F.col(ret)), by, ts))
    return cum.withColumn("peak", fr.running(F.max("cum"), by, ts)).withColumn("drawdown", c.growth("cum", "peak"))


def perf_stats(rets: DataFrame, by: str = "strategy_id", ret: str = "ret", ts: str = "period_end", freq: int = 12) -> DataFrame:
    """``cagr, volatility, sharpe, max_drawdown, total_return`` per series; years are rows / ``freq``."""
    path = equity_path(rets, by, ret, ts)
    s = path.groupBy(by).agg(
        F.count("*").alias("n_periods"),
        (F.product(1.0 + F.col(ret))).alias("_end"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(freq)))).alias("volatility"),
        (F.avg(ret) * freq).alias("_mean"),
        F.min("drawdown").alias("max_drawdown"),
    )
    return s.select(
        by,
        "n_periods",
        F.when(F.col("_end") > 0, F.pow("_end", c.ratio(F.lit(float(freq)), F.col("n_periods"))) - 1).alias("cagr"),
        "volatility",
        F.when(F.col("volatility") > 0, F.col("_mean") / F.col("volatility")).alias("sharpe"),
        "max_drawdown",
        (F.col("_end") - 1).alias("total_return"),
    )


def annual_returns(rets: DataFrame, by: str = "strategy_id", ret: str = "ret", ts: str = "period_end") -> DataFrame:
    """Compounded return per calendar year."""
    return rets.groupBy(by, F.year(ts).alias("year")).agg((F.product(1.0 + F.col(ret)) - 1.0).alias("annual_return"))


def annual_max_drawdown(rets: DataFrame, by: str = "strategy_id", ret: str = "ret", ts: str = "period_end") -> DataFrame:
    """Worst drawdown seen in each year, measured from the high since inception."""
    return equity_path(rets, by, ret, ts).groupBy(by, F.year(ts).alias("year")).agg(F.min("drawdown").alias("max_drawdown"))


def yearly_table(strategy: DataFrame, benchmark: DataFrame, by: str = "strategy_id", ts: str = "period_end") -> DataFrame:
    """Strategy beside benchmark per year (years of either side).

    ``benchmark(ts, ret)`` is one series and is matched to the years each strategy or it has.
    """
    def years(df, key, name):
        path = equity_path(df, key, "ret", ts)
        return path.groupBy(key, F.year(ts).alias("year")).agg(
            (F.product(1.0 + F.col("ret")) - 1.0).alias(f"{name}_return"), F.min("drawdown").alias(f"{name}_max_drawdown")
        )

    s = years(strategy, by, "strategy")
    b = years(benchmark.withColumn("_one", F.lit(1)), "_one", "benchmark").drop("_one")
    bench_years = b.agg(F.collect_list("year")).scalar()
    every = s.groupBy(by).agg(F.collect_set("year").alias("_y"))
    every = every.select(by, F.explode(F.array_union("_y", bench_years)).alias("year"))
    return every.join(s, [by, "year"], "left").join(b, "year", "left")


def align_benchmark(strategy: DataFrame, benchmark: DataFrame, ts: str = "period_end") -> DataFrame:
    """Keep the periods on which the benchmark has a return: adds ``benchmark_return``."""
    b = benchmark.where(F.col("ret").isNotNull()).select(ts, F.col("ret").alias("benchmark_return"))
    return strategy.join(b, ts)


def trade_stats(trades: DataFrame, equity: DataFrame, capital: float, risk_reward: float | None = None, by: str = "strategy_id") -> DataFrame:
    """Result card: end equity, CAGR on elapsed days, drawdown, win rate, average R, open trades."""
    closed = F.col("status") == "closed"
    t = trades.groupBy(by).agg(
        F.count("*").alias("n_trades"),
        F.avg(F.when(closed, (F.col("pnl") > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(closed, F.col("r_multiple"))).alias("avg_r"),
        F.count_if(F.col("status") == "open").alias("n_open"),
    )
    peak = equity.withColumn("_peak", fr.running(F.max("equity"), by, "ts"))
    e = peak.groupBy(by).agg(
        F.max_by("equity", "ts").alias("end_equity"),
        (c.elapsed_days(F.max("ts"), F.min("ts")) / 365.25).alias("_years"),
        F.min(c.growth("equity", "_peak")).alias("max_drawdown"),
    )
    grown = F.col("end_equity") / capital
    return e.join(t, by, "left").select(
        by,
        "end_equity",
        (grown - 1).alias("total_return"),
        F.when((F.col("_years") > 0) & (grown > 0), F.pow(grown, c.ratio(F.lit(1.0), F.col("_years"))) - 1).alias("cagr"),
        "max_drawdown",
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        "win_rate",
        "avg_r",
        F.lit(None if risk_reward is None else 1 / (1 + risk_reward)).cast("double").alias("breakeven_win_rate"),
        F.coalesce("n_open", F.lit(0)).alias("n_open"),
    )


def exit_reasons(trades: DataFrame, by: str = "strategy_id") -> DataFrame:
    return trades.groupBy(by, "exit_reason").agg(F.count("*").alias("n"))


def pnl_split(trades: DataFrame, by: str = "strategy_id") -> DataFrame:
    """Closed and open trades, realised and unrealised profit."""
    def total(status):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("pnl"))), F.lit(0.0))

    return trades.groupBy(by).agg(
        F.count_if(F.col("status") == "closed").alias("n_closed"),
        F.count_if(F.col("status") == "open").alias("n_open"),
        total("closed").alias("realized_pnl"),
        total("open").alias("unrealized_pnl"),
    )


def r_histogram(trades: DataFrame, low: float = -3.0, high: float = 10.0, bins: int = 40, by: str = "strategy_id") -> DataFrame:
    """Closed trades' R clipped to ``[low, high]`` and counted in ``bins`` equal bins (0-based)."""
    width = (high - low) / bins
    r = c.clip("r_multiple", low, high)
    slot = F.least(F.floor((r - low) / width).cast("int"), F.lit(bins - 1))
    rows = trades.where("status = 'closed' AND r_multiple IS NOT NULL")
    return rows.groupBy(by, slot.alias("bin")).agg(F.count("*").alias("n"))


def average_eligible(counts: DataFrame, by: str = "strategy_id", n: str = "n_ranked") -> DataFrame:
    """Mean number of eligible names over the periods that had any."""
    return counts.groupBy(by).agg(F.avg(F.nullif(F.col(n), F.lit(0))).alias("avg_eligible"))


def coverage(panel: DataFrame, day: str = "period_end", by: str = "symbol") -> DataFrame:
    """Instruments, first and last day, number of periods."""
    return panel.agg(
        F.countDistinct(by).alias("n_symbols"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.countDistinct(day).alias("n_periods"),
    )


def compounding_steps(equity: DataFrame, capital: float, step_pct: float = 50.0, by: str = "strategy_id") -> DataFrame:
    """Ratchet: how many ``step_pct`` steps the capital has taken by each bar -> ``n_steps, sizing_capital``.

    The number of whole steps below the running high; the logarithm is checked against the exact
    power on both sides so that landing on a step counts.
    """
    mult = 1 + step_pct / 100.0
    high = fr.running(F.max("equity"), by, "ts")
    raw = F.greatest(F.floor(F.ln(F.col("_high") / capital) / F.ln(F.lit(mult))), F.lit(0))
    power = lambda n: F.lit(capital) * F.pow(F.lit(mult), n)
    return (
        equity.withColumn("_high", high)
        .withColumn("_n", F.coalesce(raw, F.lit(0)))
        .withColumn(
            "n_steps",
            F.when(F.col("_high") >= power(F.col("_n") + 1), F.col("_n") + 1)
            .when((F.col("_n") > 0) & (F.col("_high") < power(F.col("_n"))), F.col("_n") - 1)
            .otherwise(F.col("_n"))
            .cast("int"),
        )
        .withColumn("sizing_capital", power(F.col("n_steps")))
        .drop("_high", "_n")
    )
