"""Strategies as a relation: same ranks and holdings as the plans written out, and a plan that does not grow with them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import holdings, strategies
from barloom.operators.ranking import RankParams, rank_universe
from barloom.plans import backtest, recompute
from barloom.session import materialise
from workload import panels

SF = "/root/testdata/sf0.001"
PARAMS = [
    RankParams("plain", 6, 1),
    RankParams("sharp", 9, 0, max_volatility_pct=400.0, use_risk_adjusted=True),
    RankParams("low", 3, 1, min_price=36_000.0, max_trailing_return_pct=10.0),
    RankParams("few", 6, 1, universe="small", max_drawdown_from_52w_high_pct=60.0),
    RankParams("old", 12, 1, use_membership=True),
]


def table(spark, params, **more):
    rows = [{k: v for k, v in p.__dict__.items()} | more for p in params]
    ddl = (
        "strategy_id string, lookback int, skip int, min_price double, max_volatility_pct double, use_risk_adjusted boolean, "
        "max_trailing_return_pct double, max_drawdown_from_52w_high_pct double, use_membership boolean, universe string"
    )
    extra = "".join(f", {k} {strategies.COLUMNS[k][0]}" for k in more)
    names = [x.split()[0] for x in (ddl + extra).split(", ")]
    return strategies.relation(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl + extra))


def tables(spark):
    daily = panels.daily_bars(spark, SF).select("symbol", "ts", "close")
    return {"membership": panels.membership(spark, SF), "universes": panels.universes(spark, SF), "daily": daily}


def ranks(df):
    return sorted((r.strategy_id, r.period_no, r.symbol, r["rank"], round(r.score, 8)) for r in df.collect())


def test_ranks_like_the_plan_written_out(spark):
    panel = panels.monthly_panel(spark, SF)
    want = ranks(rank_universe(panel, PARAMS, **tables(spark)))
    got = ranks(strategies.rank_strategies(strategies.one_panel({"month": panel}), table(spark, PARAMS), **tables(spark)))
    assert got == want and {r[0] for r in want} == {p.strategy_id for p in PARAMS}


@pytest.mark.parametrize(("hold", "n", "band", "regime"), [(1, 3, 0.0, False), (2, 4, 60.0, False), (3, 3, 50.0, True)])
def test_holdings_like_the_plan_written_out(spark, hold, n, band, regime):
    panel = panels.monthly_panel(spark, SF)
    series = panels.series(spark, SF).where("series_id IN ('1-URGENT', '5-LOW')")
    series = series.withColumn("series_id", F.when(F.col("series_id") == "5-LOW", "gold").otherwise("equity"))
    written = [
        backtest.Strategy(p, hold, n, band, regime=("equity", "gold") if regime else None, gold_entry=3, gold_exit=2) for p in PARAMS[:2]
    ]
    test = backtest.run(panel, written, series=series)
    more = {"hold": hold, "n": n, "exit_band_pct": band, "use_regime": regime, "gold_entry": 3, "gold_exit": 2}
    saved, grid = table(spark, PARAMS[:2], **more), strategies.one_panel({"month": panel})
    schedule, held = strategies.hold_strategies(grid, saved, strategies.rank_strategies(grid, saved), series)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(schedule, "strategy_id", "period_no", "rebalance_no", "regime") == rows(test.schedule, "strategy_id", "period_no", "rebalance_no", "regime")
    columns = ("strategy_id", "period_no", "symbol", "slot", "n_active", "regime")
    assert rows(held, *columns) == rows(test.holdings, *columns)
    if regime:
        assert test.schedule.where("regime = 'gold'").count() > 0
    events = rows(holdings.holdings_events(test.holdings, test.schedule), "strategy_id", "event_date", "symbol", "action")
    assert rows(strategies.events(held, schedule), "strategy_id", "event_date", "symbol", "action") == events
    assert rows(strategies.positions(held, schedule), "strategy_id", "symbol", "entry_date") == rows(
        holdings.current_positions(test.holdings, test.schedule), "strategy_id", "symbol", "entry_date"
    )


def test_plan_does_not_grow_with_the_strategies(spark):
    panel = strategies.one_panel({"month": panels.monthly_panel(spark, SF)})

    def size(n):
        some = spark.range(n).select(
            F.concat(F.lit("s"), "id").alias("strategy_id"), (3 + F.col("id") % 9).alias("lookback"), (F.col("id") % 3).alias("skip")
        )
        saved = materialise(strategies.relation(some))
        text = strategies.rank_strategies(panel, saved)._jdf.queryExecution().toString()
        return text.count("\n"), text.count("Exchange"), text.count("CartesianProduct") + text.count("BroadcastNestedLoopJoin")

    assert size(10) == size(10_000) and size(10)[2] == 0


def test_a_filter_without_its_table_is_refused(spark):
    panel = strategies.one_panel({"month": panels.monthly_panel(spark, SF)})
    for p, name in ((PARAMS[3], "universes"), (PARAMS[4], "membership")):
        with pytest.raises(ValueError, match=name):
            strategies.rank_strategies(panel, table(spark, [p]))


def test_registry_of_bad_rows_and_missing_values(spark):
    base = {"lookback_months": 3, "skip_months": 0, "hold_months": 1, "n_stocks": 2, "min_price": 1.0, "universe": "all"}
    rows = [("a", {}), ("b", {"use_exit_band": True, "exit_band_pct": 50.0}), ("c", {"use_exit_band": True}), ("d", {"lookback_months": None}), ("e", {"n_stocks": 0})]
    registry = spark.createDataFrame(
        [(i, i, json.dumps(base | more)) for i, more in rows] + [("f", "f", "not json"), ("g", "g", None)],
        "strategy_id string, name string, parameters string",
    )
    saved = {r.strategy_id: r for r in recompute.strategy_table(registry).collect()}
    assert set(saved) == {"a", "b", "c"}
    assert (saved["a"].exit_band_pct, saved["b"].exit_band_pct, saved["c"].exit_band_pct) == (0.0, 50.0, 0.0)
    assert (saved["a"].universe, saved["a"].grid, saved["a"].gold_entry, saved["a"].use_regime) == (None, "month|Adj Close", 150, False)
    done = recompute.recompute_all(registry, {"month": panels.monthly_panel(spark, SF)})
    assert sorted(r.strategy_id for r in done.rejected.collect()) == ["d", "e", "f", "g"]
    assert {r.strategy_id for r in done.positions.collect()} == {"a", "b", "c"}
    none = recompute.recompute_all(registry.where("strategy_id = 'f'"), {"month": panels.monthly_panel(spark, SF)})
    assert none.events.collect() == [] and none.positions.collect() == []


def test_equal_strategies_are_ranked_and_simulated_once(spark, monkeypatch):
    """A kind of many members costs one ranking; an id of several rows keeps its ranking over all of them."""
    panel = panels.monthly_panel(spark, SF)
    base = {"skip_months": 0, "hold_months": 1, "min_price": 1.0, "universe": "all"}
    rows = [(f"s{k:03d}", base | {"lookback_months": 3 + k % 2, "n_stocks": 2 + k % 2}) for k in range(40)]
    rows += [("twice", base | {"lookback_months": 3, "n_stocks": n}) for n in (2, 3)] + [(None, base | {"lookback_months": 3, "n_stocks": 2})]
    ddl = "strategy_id string, name string, parameters string"
    registry = spark.createDataFrame([(i, i, json.dumps(p)) for i, p in rows], ddl)
    saved, grid = materialise(recompute.strategy_table(registry)), strategies.one_panel({"month|Adj Close": panel})
    best = lambda df: sorted((r.strategy_id, r.period_no, r["rank"], r.symbol) for r in df.collect())
    every = strategies.rank_strategies(grid, saved)
    want = best(every.join(saved.select("strategy_id", "n"), "strategy_id").where("rank <= n"))
    alone = recompute.recompute_all(registry.where("strategy_id = 's000'"), {"month": panel})
    one = {k: sorted(tuple(r)[1:] for r in getattr(alone, k).collect()) for k in ("events", "positions")}

    ranked, rank = [], strategies.rank_strategies
    monkeypatch.setattr(strategies, "rank_strategies", lambda panel, some, *a: ranked.append(some.count()) or rank(panel, some, *a))
    monkeypatch.setattr(strategies, "_SPREAD", 7)
    done = recompute.recompute_all(registry, {"month": panel})
    for k, rows_of_one in one.items():
        found = [tuple(r) for r in getattr(done, k).collect()]
        assert {r[0] for r in found} >= {f"s{k:03d}" for k in range(40)}
        assert rows_of_one and all(sorted(r[1:] for r in found if r[0] == f"s{j:03d}") == rows_of_one for j in (0, 2, 38))
    assert best(strategies.rank_best(grid, saved)) == want and {r[0] for r in want} > {"s000", "twice"}
    assert ranked == [4, 4]
