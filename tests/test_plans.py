"""Physical plans: pruning, pushdown, shared shuffles (test_queries rules out cartesian products)."""

from pyspark.sql import functions as F

from barloom.operators import grid, indicators, ranking, trades, upsert
from barloom.operators.ranking import RankParams
from workload import panels

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_rank_bound_prunes_before_shuffle(spark):
    ranked = ranking.rank_universe(panels.monthly_panel(spark, SF), [RankParams()])
    text = plan(ranked.where("rank <= 5"))
    assert text.count("WindowGroupLimit") == 2


def test_many_strategies_share_the_panel_shuffle(spark):
    panel = panels.monthly_panel(spark, SF)
    one = plan(ranking.rank_universe(panel, [RankParams("a", 12, 1)]))
    many = plan(ranking.rank_universe(panel, [RankParams(f"s{i}", 3 + i % 9, i % 3) for i in range(60)]))
    assert many.count("Exchange hashpartitioning") == one.count("Exchange hashpartitioning") == 2


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 40").select("l_shipdate"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_asof_window_is_cut_into_blocks(spark):
    bars = panels.daily_bars(spark, SF).select("symbol", "ts", "close")
    text = plan(grid.asof_join(bars, bars.withColumnRenamed("close", "v"), "symbol", ["v"]))
    assert "hashpartitioning(symbol" in text and "_block" in text


def test_no_frame_reads_the_rest_of_a_partition(spark):
    bars = panels.daily_bars(spark, SF)
    slots = grid.calendar(bars)
    for df in (
        grid.interpolate_linear(bars, "close"),
        grid.next_slot(bars.select("ts"), slots, "ts"),
        indicators.trailing_high(bars, panels.monthly_panel(spark, SF)),
    ):
        assert "unboundedfollowing" not in plan(df).lower()


def test_upserts_do_not_sort_the_store(spark):
    bars = panels.daily_bars(spark, SF).select("symbol", "ts", "close")
    for prefer in ("fresh", "existing"):
        text = plan(upsert.upsert(bars, bars.where("ts >= DATE '1998-01-01'"), ["symbol", "ts"], prefer))
        assert "SortAggregate" not in text and "Join" in text


def test_indicators_and_pairing_stay_in_the_jvm(spark):
    bars = panels.daily_bars(spark, SF).withColumn("idx", F.datediff("ts", F.lit("1990-01-01")))
    signals = bars.selectExpr("symbol", "ts", "close AS price", "close > open AS enter", "close < low AS leave")
    for df in (indicators.ema(bars, {"e": 10}), indicators.rsi(bars), trades.pair_trades(signals, ["symbol"])):
        assert "InPandas" not in plan(df) and "InArrow" not in plan(df)
