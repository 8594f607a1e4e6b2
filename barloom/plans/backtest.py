"""Momentum backtest: ranking -> holdings -> returns -> overlays, for many strategies at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import holdings as h
from barloom.operators import leverage as lev
from barloom.operators import perf, returns
from barloom.operators.ranking import RankParams, rank_universe
from barloom.session import materialise


@dataclass(frozen=True)
class Strategy:
    """Everything that decides what a strategy holds and earns."""

    rank: RankParams
    hold: int = 1
    n: int = 30
    exit_band_pct: float = 0.0
    weighting: str = "equal"
    regime: tuple[str, str] | None = None  # (equity series, gold series)
    gold_entry: int = 150
    gold_exit: int = 55
    freq: str = "month"

    @property
    def strategy_id(self) -> str:
        return self.rank.strategy_id


@dataclass
class Backtest:
    ranking: DataFrame
    schedule: DataFrame
    holdings: DataFrame
    returns: DataFrame


def run(
    panel: DataFrame,
    strategies: Sequence[Strategy],
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
    series: DataFrame | None = None,
    gap: str = "drop",
) -> Backtest:
    """Run all ``strategies`` over one ``panel(symbol, period_end, period_no, price)``.

    Ranking is one plan for all of them; strategies that share hold, size, band, weighting and regime
    settings also share the plan of everything after it, with ``strategy_id`` as a data column.  The
    used ranks, the counts, the schedule and folded holdings are small and written once, because every later
    operator reads them several times.
    ``series(series_id, period_no, value)`` feeds the regime filter.
    """
    strategies = list(strategies)
    if len({s.freq for s in strategies}) != 1:
        raise ValueError("strategies of one run share the panel's period grid")
    freq = strategies[0].freq
    ranking = rank_universe(panel, [s.rank for s in strategies], membership, universes, daily)
    # a literal bound on the rank prunes every task to its best rows before the shuffle, and the counts
    # combine before theirs: reading the panel twice is cheaper than shuffling every ranked row
    reach = max(int(s.n * (1 + s.exit_band_pct / 100.0)) for s in strategies)
    top = materialise(ranking.where(F.col("rank") <= reach))
    counts = materialise(h.ranked_counts(ranking))
    periods = h.strategy_periods(panel, [s.rank for s in strategies])

    groups: dict[tuple, list[Strategy]] = {}
    for s in strategies:
        key = (s.hold, s.n, s.exit_band_pct, s.weighting, s.regime, s.gold_entry, s.gold_exit)
        groups.setdefault(key, []).append(s)

    parts = []
    for (hold, n, band, weighting, regime, enter, leave), members in groups.items():
        ids = [s.strategy_id for s in members]
        mine = F.col("strategy_id").isin(ids)
        signals = gold = None
        if regime is not None:
            if series is None:
                raise ValueError("the regime filter needs the equity and gold series")
            signals = h.regime_signals(series, regime[0], regime[1], enter, leave)
            gold = series.where(F.col("series_id") == regime[1])
        span = periods.where(mine)
        schedule = materialise(h.rebalance_schedule(span, counts.where(mine), hold, n, signals))
        ranked = top.where(mine)
        if band > 0:
            held = materialise(h.with_exit_band(ranked, schedule, n, band, freq))
        else:
            held = h.top_n(ranked, schedule, n, freq)
        rets = returns.portfolio_returns(panel, held, schedule, span, weighting, gold, gap, freq)
        parts.append((schedule, held, rets))

    def union(i):
        out = parts[0][i]
        for p in parts[1:]:
            out = out.unionByName(p[i])
        return out

    return Backtest(ranking, union(0), union(1), union(2))


def with_overlays(
    test: Backtest,
    panel: DataFrame,
    bars: DataFrame,
    stoploss_pct: float | None = None,
    max_reentries: int = 0,
    next_open: bool = False,
    freq: str = "month",
) -> DataFrame:
    """Returns after the daily overlays; where both apply, next-open execution wins."""
    overlays = []
    if stoploss_pct is not None:
        overlays.append(returns.stoploss_overlay(panel, bars, test.holdings, test.schedule, stoploss_pct, max_reentries, freq))
    if next_open:
        overlays.append(returns.execution_lag_overlay(panel, bars, test.holdings, test.schedule, freq))
    return returns.merge_overlays(test.returns, *overlays) if overlays else test.returns


def levered(rets: DataFrame, annual_interest_pct: float = 10.0, **params) -> DataFrame:
    """Returns with the drawdown-triggered leverage overlay in place of the plain ones."""
    overlay = lev.leverage_overlay(rets, lev.leverage_tranches(rets, **params), annual_interest_pct)
    return overlay.withColumn("ret", F.col("leveraged_return")).select(*rets.columns, "lev_frac", "interest")


def report(rets: DataFrame, benchmark: DataFrame, freq: int = 12, since=None) -> dict[str, DataFrame]:
    """Performance tables on the benchmark's dates: ``stats``, ``benchmark_stats``, ``yearly``.

    ``since`` cuts the results only; rankings have used the history before it.
    """
    aligned = perf.align_benchmark(rets, benchmark)
    if since is not None:
        aligned = aligned.where(F.col("period_end") >= F.lit(since).cast("date"))
    bench = aligned.select("strategy_id", "period_end", F.col("benchmark_return").alias("ret"))
    one = aligned.select("period_end", F.col("benchmark_return").alias("ret")).distinct()
    return {
        "stats": perf.perf_stats(aligned, freq=freq),
        "benchmark_stats": perf.perf_stats(bench, freq=freq),
        "yearly": perf.yearly_table(aligned, one),
    }
