"""Strategies as a relation: one row a strategy, a plan of the same size for ten of them and for ten thousand.

A strategy's parameters are columns, so look-backs, thresholds, universes and holding rules are joined to the panel instead of being
written into the plan.  ``strategies`` has the columns of :data:`COLUMNS`; ``panel(grid, symbol, period_end, period_no, price)`` holds any
number of grids one below the other (months and weeks, adjusted and plain closes), and a strategy meets the one it names.

Every price a strategy asks for is an equi-join on (grid, symbol, period): the end of a window with its start, ``lookback`` periods
before, then the ranked period with the window's end, ``skip`` periods before.  Windows are measured once for each distinct
(lookback, skip), however many strategies share it.  The deviation of a window's returns is the difference of running sums at its ends.
Strategies with the same parameters are of one kind (:func:`shared`), which is ranked and simulated once; its results go to all members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators import holdings as h
from barloom.operators.indicators import PERIODS_PER_YEAR, trailing_high
from barloom.operators.ranking import SCORE_DIGITS, flag_members
from barloom.session import materialise

#: Parameters of a strategy and what a missing one means (None: the filter is off).
COLUMNS = {
    "grid": ("string", "month"),
    "freq": ("string", "month"),
    "lookback": ("int", 12),
    "skip": ("int", 1),
    "hold": ("int", 1),
    "n": ("int", 30),
    "exit_band_pct": ("double", 0.0),
    "min_price": ("double", 10.0),
    "max_volatility_pct": ("double", None),
    "use_risk_adjusted": ("boolean", False),
    "max_trailing_return_pct": ("double", None),
    "max_drawdown_from_52w_high_pct": ("double", None),
    "use_membership": ("boolean", False),
    "universe": ("string", None),
    "use_regime": ("boolean", False),
    "gold_entry": ("int", 150),
    "gold_exit": ("int", 55),
}


#: Parameters that the ranking depends on.
RANKING = (
    "grid", "lookback", "skip", "min_price", "max_volatility_pct", "use_risk_adjusted", "max_trailing_return_pct",
    "max_drawdown_from_52w_high_pct", "use_membership", "universe",
)
#: Strategies whose rows one task ranks, and members to whom one task hands the rows of their kinds.
_RANKED, _SPREAD = 250, 500


def relation(strategies: DataFrame) -> DataFrame:
    """``strategies`` with all of :data:`COLUMNS`, missing columns and values filled in."""
    have = set(strategies.columns)
    value = lambda k: F.col(k) if k in have else F.lit(None)
    filled = [F.coalesce(value(k).cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in COLUMNS.items()]
    return strategies.select("strategy_id", *filled)


def shared(strategies: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Strategies with equal values of ``by`` as one: a row of each kind, and ``(kind, *columns)``, the kind of every row.

    A kind is named after its least strategy.  An id of several rows is a kind of its own with all of them; rows without an id are left out.
    """
    rows = strategies.where("strategy_id IS NOT NULL")
    rows = rows.withColumn("_rows", F.count("*").over(Window.partitionBy("strategy_id")))
    rows = rows.withColumn("_same", F.when(F.col("_rows") == 1, F.to_json(F.struct(*by))).otherwise(F.concat(F.lit("="), "strategy_id")))
    rows = rows.join(rows.groupBy("_same").agg(F.min("strategy_id").alias("kind")), "_same")
    rows = materialise(rows.select("kind", *strategies.columns))
    return rows.where("strategy_id = kind").drop("kind"), rows


def to_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` of kinds (their ``strategy_id``) for every one of ``members(kind, strategy_id, ...)``.

    The members of a kind are dealt out in bounded shares, so one that most strategies are of is spread over many tasks.
    """
    shares = members.groupBy("kind").agg(F.ceil(F.count("*") / _SPREAD).cast("int").alias("_shares"))
    parts = members.count() // _SPREAD + 1
    dealt = members.join(shares, "kind").withColumn("_share", F.pmod(F.xxhash64("strategy_id"), F.col("_shares")).cast("int"))
    rows = rows.withColumnRenamed("strategy_id", "kind").join(shares, "kind")
    rows = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return rows.repartition(parts, "kind", "_share").join(dealt.drop("_shares"), ["kind", "_share"]).drop("kind", "_share")


def one_panel(panels: dict[str, DataFrame]) -> DataFrame:
    """Panels by grid name -> one panel with a column ``grid``.

    The name hangs on the row, as the optimizer would fold a constant away and join without a key.
    """
    out = None
    for grid, panel in panels.items():
        name = F.concat(F.lit(grid), F.substring("symbol", 1, 0)).alias("grid")
        part = panel.select(name, "symbol", "period_end", "period_no", "price")
        out = part if out is None else out.unionByName(part)
    return out


def measure(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Momentum and volatility of every distinct window of ``windows(grid, lookback, skip)`` for every priced row of the panel.

    Adds ``lookback, skip, mom, volatility`` to the panel's columns; rows without a positive price at both ends are left out.
    """
    by = ["grid", "symbol"]
    rows = panel.where("price IS NOT NULL").withColumn("_r", c.growth("price", fr.at("price", 1, by, "period_no")))
    sums = {"_k": F.count("_r"), "_s": F.sum("_r"), "_q": F.sum(F.col("_r") * F.col("_r"))}
    rows = rows.withColumns({k: F.coalesce(fr.running(v, by, "period_no"), F.lit(0)) for k, v in sums.items()})
    spans = windows.select("grid", "lookback").distinct()
    end = rows.where("price > 0").join(spans, "grid").withColumn("_from", F.col("period_no") - F.col("lookback"))
    start = rows.where("price > 0").select(
        *by, F.col("period_no").alias("_from"), F.col("price").alias("_paid"), *[F.col(k).alias(f"{k}0") for k in sums]
    )
    span = end.join(start, [*by, "_from"])
    k, s, q = (F.col(x) - F.col(f"{x}0") for x in sums)
    spread = F.sqrt(F.greatest(q - s * s / k, F.lit(0.0)) / (k - 1))
    measured = span.select(
        *by, "lookback", F.col("period_no").alias("_end"), c.growth("price", "_paid").alias("mom"),
        F.when(k > 1, spread * F.sqrt(F.lit(PERIODS_PER_YEAR))).alias("volatility"),
    )
    asked = measured.join(windows.select("grid", "lookback", "skip").distinct(), ["grid", "lookback"])
    asked = asked.withColumn("period_no", F.col("_end") + F.col("skip")).drop("_end")
    return panel.where("price IS NOT NULL").join(asked, [*by, "period_no"])


def _asked(strategies: DataFrame):
    """Which tables some strategy needs, and the longest list of names any of them looks at."""
    used = lambda k: F.max(F.coalesce(F.col(k), F.lit(False)))
    band = F.floor(F.col("n") * (1 + F.col("exit_band_pct") / 100.0))
    return strategies.agg(
        used("use_membership").alias("membership"),
        F.max(F.col("universe").isNotNull()).alias("universes"),
        F.max(F.col("max_drawdown_from_52w_high_pct").isNotNull()).alias("daily"),
        used("use_regime").alias("series"),
        F.max(band).cast("int").alias("reach"),
        F.count("*").alias("rows"),
    ).first()


def rank_strategies(
    panel: DataFrame,
    strategies: DataFrame,
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Eligible instruments per (strategy, period), best first, as :func:`barloom.operators.ranking.rank_universe` ranks them.

    ``(strategy_id, grid, period_no, period_end, symbol, price, mom, volatility, score, rank)``.  A strategy on a grid that the panel lacks
    ranks nothing.
    """
    asked = _asked(strategies)
    for name, table in (("membership", membership), ("universes", universes), ("daily", daily)):
        if asked[name] and table is None:
            raise ValueError(f"a strategy's filter needs the table '{name}'")
    base = panel.select("grid", "symbol", "period_end", "period_no", "price")
    flags = {"_member": F.lit(None).cast("boolean"), "high_52w": F.lit(None).cast("double")}
    if asked["membership"]:
        base = flag_members(base, membership, "period_end", alias="_member")
    if asked["daily"]:
        base = base.join(trailing_high(daily, base.select("symbol", "period_end")), ["symbol", "period_end"], "left")
    base = base.withColumns({k: v for k, v in flags.items() if k not in base.columns})
    # a small panel, but a row of it becomes one for every strategy
    measured = measure(base, strategies.select("grid", "lookback", "skip"))
    measured = measured.repartition(asked["rows"] // _RANKED + 2, "grid", "symbol", "period_no")
    rows = measured.join(strategies, ["grid", "lookback", "skip"])
    if asked["universes"]:
        inside = universes.select(F.col("universe_id").alias("universe"), "symbol", F.lit(True).alias("_inside")).distinct()
        rows = rows.join(inside, ["universe", "symbol"], "left")
    else:
        rows = rows.withColumn("_inside", F.lit(None).cast("boolean"))
    vol, mom = F.col("volatility"), F.col("mom")
    unset = lambda k: F.col(k).isNull()
    ok = mom.isNotNull() & (F.col("price") >= F.col("min_price"))
    ok &= ~F.col("use_membership") | F.col("_member")
    ok &= unset("universe") | F.col("_inside")
    ok &= unset("max_trailing_return_pct") | (mom <= F.col("max_trailing_return_pct") / 100.0)
    ok &= unset("max_volatility_pct") | (vol <= F.col("max_volatility_pct") / 100.0)
    ok &= ~F.col("use_risk_adjusted") | (vol > 1e-9)
    near_high = c.ratio("price", "high_52w") >= 1 - F.col("max_drawdown_from_52w_high_pct") / 100.0
    ok &= unset("max_drawdown_from_52w_high_pct") | near_high
    score = F.when(F.col("use_risk_adjusted"), c.ratio(mom, vol)).otherwise(mom)
    scored = rows.where(c.holds(ok)).select(
        "strategy_id", "grid", "period_no", "period_end", "symbol", "price", "mom", "volatility", score.alias("score")
    )
    w = Window.partitionBy("strategy_id", "period_no").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "symbol")
    return scored.withColumn("rank", F.row_number().over(w))


def rank_best(
    panel: DataFrame,
    strategies: DataFrame,
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """The first ``n`` of each strategy's ranking, see :func:`rank_strategies`; strategies that rank alike are ranked once.

    An id of several rows is ranked over all of them, and cut for each of them.
    """
    kinds, members = shared(strategies, [*RANKING, "n"])
    ranking = rank_strategies(panel, kinds, membership, universes, daily)
    most = kinds.groupBy("strategy_id").agg(F.max("n").alias("_most"))
    best = ranking.join(most, "strategy_id").where(F.col("rank") <= F.col("_most")).drop("_most")
    return to_members(best, members.select("kind", "strategy_id", "n")).where(F.col("rank") <= F.col("n")).drop("n")


def gold_signals(series: DataFrame, strategies: DataFrame, equity_id: str = "equity", gold_id: str = "gold") -> DataFrame:
    """Regime signals of every distinct (``gold_entry``, ``gold_exit``): ``(gold_entry, gold_exit, period_no, to_gold, to_equity)``."""
    pairs = strategies.where("use_regime").select("gold_entry", "gold_exit").distinct()
    ids = F.explode(F.array(F.lit(equity_id), F.lit(gold_id))).alias("series_id")
    spans = pairs.select(F.explode(F.array("gold_entry", "gold_exit")).alias("span")).distinct().select("span", ids)
    now = series.select("series_id", "period_no", "value").join(spans, "series_id")
    before = series.select("series_id", F.col("period_no").alias("_from"), F.col("value").alias("_paid"))
    trail = now.withColumn("_from", F.col("period_no") - F.col("span")).join(before, ["series_id", "_from"], "left")
    grown = lambda name: F.max(F.when(F.col("series_id") == name, c.growth("value", "_paid")))
    lead = trail.groupBy("span", "period_no").agg(grown(gold_id).alias("_gold"), grown(equity_id).alias("_equity"))
    enter = lead.select(F.col("span").alias("gold_entry"), "period_no", c.holds(F.col("_gold") > F.col("_equity")).alias("to_gold"))
    leave = lead.select(F.col("span").alias("gold_exit"), "period_no", c.holds(F.col("_equity") > F.col("_gold")).alias("to_equity"))
    return pairs.join(enter, "gold_entry").join(leave, ["gold_exit", "period_no"])


def simulated_periods(panel: DataFrame, strategies: DataFrame) -> DataFrame:
    """``strategies`` spelled out over the periods each one is simulated on, see :func:`barloom.operators.holdings.strategy_periods`."""
    edges = panel.groupBy("grid").agg(F.min("period_no").alias("_a"), F.max("period_no").alias("_b"))
    rows = strategies.join(edges, "grid").withColumn("_a", F.col("_a") + F.col("lookback") + F.col("skip") + 1).where("_a <= _b")
    return rows.withColumn("period_no", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def hold_strategies(
    panel: DataFrame, strategies: DataFrame, ranking: DataFrame, series: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Schedule and holdings of every strategy: ``(strategy_id, freq, period_no, rebalance_no, regime)`` and the same with ``symbol, slot, n_active``."""
    asked = _asked(strategies)
    if asked["series"] and series is None:
        raise ValueError("the regime filter needs the equity and gold series")
    rules = strategies.select("strategy_id", "n", "exit_band_pct")
    reach = F.floor(F.col("n") * (1 + F.col("exit_band_pct") / 100.0))
    # the longest list bounds the rank before the shuffle, each strategy's own one afterwards
    top = ranking.where(F.col("rank") <= (asked["reach"] or 0)).join(rules, "strategy_id").where(F.col("rank") <= reach)
    top = materialise(top.select("strategy_id", "period_no", "symbol", "rank", "n", "exit_band_pct"))
    signals = gold_signals(series, strategies) if asked["series"] else None
    periods = simulated_periods(panel, strategies)
    if signals is not None:
        periods = periods.withColumns({k: F.when(F.col("use_regime"), F.col(k)) for k in ("gold_entry", "gold_exit")})
    schedule = h.rebalance_schedule(periods, h.ranked_counts(ranking), "hold", "n", signals)
    schedule = materialise(schedule.join(strategies.select("strategy_id", "freq"), "strategy_id"))
    plain = h.top_n(top.where("exit_band_pct = 0"), schedule.join(rules.where("exit_band_pct = 0"), "strategy_id", "left_semi"), "n")
    banded = h.with_exit_band(
        top.where("exit_band_pct > 0"), schedule.join(rules.where("exit_band_pct > 0"), "strategy_id", "left_semi"), "n", "exit_band_pct"
    )
    held = plain.unionByName(banded).drop("rebalance_date").join(strategies.select("strategy_id", "freq"), "strategy_id")
    return schedule, materialise(held)


def label(no: str | Column, freq: str = "freq") -> Column:
    """End of a period on the grid that the row names."""
    out = F.lit(None).cast("date")
    for f in c.FREQS:
        out = F.when(F.col(freq) == f, c.period_end_of(no, f)).otherwise(out)
    return out


def events(held: DataFrame, schedule: DataFrame) -> DataFrame:
    """Dated entries and exits: ``(strategy_id, event_date, symbol, action)``."""
    changes = h.holding_changes(held, schedule).join(schedule.select("strategy_id", "freq").distinct(), "strategy_id")
    return changes.select("strategy_id", label("period_no").alias("event_date"), "symbol", "action")


def positions(held: DataFrame, schedule: DataFrame) -> DataFrame:
    """Names held after each strategy's last rebalance and since when: ``(strategy_id, symbol, entry_date)``."""
    entered = h.current_entries(held, schedule).join(schedule.select("strategy_id", "freq").distinct(), "strategy_id")
    return entered.select("strategy_id", "symbol", label("entry_period").alias("entry_date"))
