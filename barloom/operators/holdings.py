"""From rankings to holdings: schedule, hysteresis, regimes, spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.operators.indicators import relative_return

GOLD = "GOLD"


def strategy_periods(panel: DataFrame, strategies) -> DataFrame:
    """``(strategy_id, period_no)`` for every period a strategy is simulated on.

    It starts ``lookback + skip + 1`` periods after the panel does and includes empty periods.
    """
    edges = panel.agg(F.min("period_no").alias("_a"), F.max("period_no").alias("_b"))
    offsets = F.array(
        *[F.struct(F.lit(s.strategy_id).alias("strategy_id"), F.lit(s.lookback + s.skip + 1).alias("_o")) for s in strategies]
    )
    rows = edges.select("_a", "_b", F.inline(offsets)).where("_a + _o <= _b")
    return rows.select("strategy_id", F.explode(F.sequence(F.col("_a") + F.col("_o"), F.col("_b"))).alias("period_no"))


def regime_signals(series: DataFrame, equity_id: str, gold_id: str, enter: int = 150, leave: int = 55) -> DataFrame:
    """Per period: does gold lead over ``enter`` periods (``to_gold``), equity over ``leave`` (``to_equity``)?

    ``series(series_id, period_no, value)``.
    """
    trail = relative_return(series.where(F.col("series_id").isin(equity_id, gold_id)), [enter, leave])

    def of(series_id, n):
        return F.max(F.when(F.col("series_id") == series_id, F.col(f"trail_{n}")))

    return trail.groupBy("period_no").agg(
        c.holds(of(gold_id, enter) > of(equity_id, enter)).alias("to_gold"),
        c.holds(of(equity_id, leave) > of(gold_id, leave)).alias("to_equity"),
    )


def _given(x: int | float | str):
    """A parameter as a column: a number, or the name of the column that holds it."""
    return F.col(x) if isinstance(x, str) else F.lit(x)


def rebalance_schedule(
    periods: DataFrame, counts: DataFrame, hold: int | str = 1, n: int | str = 30, signals: DataFrame | None = None
) -> DataFrame:
    """Rebalances of each strategy: ``(strategy_id, period_no, rebalance_no, regime)``.

    A rebalance is due ``hold`` periods after the last one, and every period while nothing is held; a
    due equity rebalance with fewer than ``n`` ranked names is retried next period.  With ``signals``
    (see :func:`regime_signals`) the regime may flip at a due date: in the gold regime the rebalance
    holds gold.  The fold runs over one strategy's periods, a few hundred small structs, inside a
    single ``aggregate`` expression.  ``hold`` and ``n`` may name columns of ``periods``, one value a strategy; ``signals`` may have
    further columns of ``periods`` to be looked up by.
    """
    rows = periods.join(
        counts.select("strategy_id", "period_no", F.col("n_ranked")), ["strategy_id", "period_no"], "left"
    ).withColumn("n_ranked", F.coalesce("n_ranked", F.lit(0)))
    if signals is None:
        rows = rows.withColumns({"to_gold": F.lit(False), "to_equity": F.lit(False)})
    else:
        by = ["period_no", *[k for k in signals.columns if k in periods.columns and k != "period_no"]]
        rows = rows.join(signals, by, "left").withColumns(
            {"to_gold": c.holds(F.col("to_gold")), "to_equity": c.holds(F.col("to_equity"))}
        )
    path = rows.groupBy("strategy_id").agg(
        F.array_sort(F.collect_list(F.struct("period_no", "n_ranked", "to_gold", "to_equity"))).alias("_path"),
        F.max(_given(hold)).alias("_hold"),
        F.max(_given(n)).alias("_least"),
    )
    start = F.struct(
        F.lit(False).alias("gold"),
        F.lit(False).alias("holding"),
        F.lit(0).alias("age"),
        F.array().cast("array<struct<period_no:int,regime:string>>").alias("out"),
    )

    def step(s, p):
        age = s["age"] + 1
        due = ~(s["holding"] | s["gold"]) | (age >= F.col("_hold"))
        gold = F.when(due, F.when(s["gold"], ~p["to_equity"]).otherwise(p["to_gold"])).otherwise(s["gold"])
        equity = due & ~gold & (p["n_ranked"] >= F.col("_least"))
        done = (due & gold) | equity
        event = F.struct(p["period_no"].alias("period_no"), F.when(gold, "gold").otherwise("equity").alias("regime"))
        return F.struct(
            gold.alias("gold"),
            F.when(due & gold, F.lit(False)).when(equity, F.lit(True)).otherwise(s["holding"]).alias("holding"),
            F.when(done, F.lit(0)).otherwise(age).alias("age"),
            F.when(done, F.array_append(s["out"], event)).otherwise(s["out"]).alias("out"),
        )

    return path.select(
        "strategy_id", F.posexplode(F.aggregate("_path", start, step)["out"]).alias("rebalance_no", "_e")
    ).select("strategy_id", "_e.period_no", "rebalance_no", "_e.regime")


def ranked_counts(ranking: DataFrame) -> DataFrame:
    """Eligible names per (strategy, period) -> ``n_ranked``."""
    return ranking.groupBy("strategy_id", "period_no").agg(F.count("*").cast("int").alias("n_ranked"))


def top_n(ranking: DataFrame, schedule: DataFrame, n: int | str, freq: str = "month") -> DataFrame:
    """Plain holdings: the first ``n`` of each equity rebalance, one GOLD row per gold rebalance.

    With a number ``rank <= n`` is a literal bound, so the ranking window keeps only ``n`` rows per task and group; ``n`` may also
    name a column of the ranking.
    """
    keys = ["strategy_id", "period_no"]
    equity = schedule.where("regime = 'equity'").join(ranking.where(F.col("rank") <= _given(n)), keys)
    equity = equity.select(
        *keys, "rebalance_no", "regime", "symbol", F.col("rank").alias("slot"), _given(n).alias("n_active")
    )
    return _with_gold(equity, schedule, freq)


def with_exit_band(
    ranking: DataFrame, schedule: DataFrame, n: int | str, exit_band_pct: float | str, freq: str = "month"
) -> DataFrame:
    """Hysteresis: a held name stays while its rank is within ``n * (1 + pct/100)``; the best
    non-held names fill the free slots.  Survivors keep their order, entrants follow by rank.

    The fold of a strategy sees one short symbol array per rebalance (ranks beyond the band are cut
    before the shuffle; filling never looks past them).  ``n`` and ``exit_band_pct`` may name columns of the ranking.
    """
    numbers = not isinstance(n, str) and not isinstance(exit_band_pct, str)
    band = F.lit(int(n * (1 + exit_band_pct / 100.0))) if numbers else F.floor(_given(n) * (1 + _given(exit_band_pct) / 100.0))
    keys = ["strategy_id", "period_no"]
    near = ranking.where(F.col("rank") <= band).join(schedule.where("regime = 'equity'"), keys, "left_semi")
    lists = near.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda s: s["symbol"]).alias("best"),
        F.max(_given(n)).alias("_n"),
    )
    steps = schedule.join(lists, keys, "left").groupBy("strategy_id").agg(
        F.array_sort(F.collect_list(F.struct("rebalance_no", "period_no", "regime", "best"))).alias("_steps"), F.max("_n").alias("_n")
    )
    start = F.struct(
        F.array().cast("array<string>").alias("held"),
        F.array().cast("array<struct<period_no:int,rebalance_no:int,held:array<string>>>").alias("out"),
    )

    def step(s, p):
        kept = F.filter(s["held"], lambda x: F.array_contains(p["best"], x))
        entrants = F.slice(F.array_except(p["best"], kept), F.lit(1), F.greatest(F.col("_n") - F.size(kept), F.lit(0)))
        held = F.when(p["regime"] == "gold", F.array().cast("array<string>")).otherwise(F.concat(kept, entrants))
        event = F.struct(p["period_no"].alias("period_no"), p["rebalance_no"].alias("rebalance_no"), held.alias("held"))
        return F.struct(held.alias("held"), F.array_append(s["out"], event).alias("out"))

    events = steps.select("strategy_id", F.inline(F.aggregate("_steps", start, step)["out"]))
    equity = events.select(
        "strategy_id",
        "period_no",
        "rebalance_no",
        F.lit("equity").alias("regime"),
        F.size("held").alias("n_active"),
        F.posexplode("held").alias("_p", "symbol"),
    ).withColumn("slot", F.col("_p") + 1)
    return _with_gold(equity.drop("_p"), schedule, freq)


def _with_gold(equity: DataFrame, schedule: DataFrame, freq: str) -> DataFrame:
    gold = schedule.where("regime = 'gold'").select(
        "strategy_id",
        "period_no",
        "rebalance_no",
        "regime",
        F.lit(GOLD).alias("symbol"),
        F.lit(1).alias("slot"),
        F.lit(0).alias("n_active"),
    )
    return equity.unionByName(gold).withColumn("rebalance_date", c.period_end_of("period_no", freq))


def regime_segments(schedule: DataFrame, freq: str = "month") -> DataFrame:
    """Stretches of one regime: ``(strategy_id, segment_no, start, last_rebalance, regime)``.

    A segment lasts until the rebalance that switches away from it.
    """
    w = Window.partitionBy("strategy_id").orderBy("rebalance_no")
    flips = schedule.withColumn("_new", F.coalesce(F.lag("regime").over(w) != F.col("regime"), F.lit(True)).cast("int"))
    flips = flips.withColumn("segment_no", F.sum("_new").over(w))
    last = F.max("period_no").over(Window.partitionBy("strategy_id"))
    seg = flips.withColumn("_last", last).groupBy("strategy_id", "segment_no").agg(
        F.min("period_no").alias("_start"), F.first("regime").alias("regime"), F.first("_last").alias("_last")
    )
    nxt = F.lead("_start").over(Window.partitionBy("strategy_id").orderBy("segment_no"))
    return seg.select(
        "strategy_id",
        "segment_no",
        c.period_end_of("_start", freq).alias("start"),
        c.period_end_of(F.coalesce(nxt, F.col("_last")), freq).alias("last_rebalance"),
        "regime",
    )


def spells(schedule: DataFrame, last_period_no=None) -> DataFrame:
    """Spell out the periods earned by each rebalance: from the next period through the next rebalance.

    ``last_period_no`` (column or int) closes the last spell.  Output ``(strategy_id, rebalance_no,
    rebalance_period, next_period, regime, period_no)``; joins on ``period_no`` replace range joins.
    """
    w = Window.partitionBy("strategy_id").orderBy("rebalance_no")
    last = F.lit(last_period_no) if isinstance(last_period_no, int) else last_period_no
    return (
        schedule.select("strategy_id", "rebalance_no", "regime", F.col("period_no").alias("rebalance_period"))
        .withColumn("next_period", F.coalesce(F.lead("rebalance_period").over(w), last))
        .where("next_period > rebalance_period")
        .withColumn("period_no", F.explode(F.sequence(F.col("rebalance_period") + 1, F.col("next_period"))))
    )


def holding_changes(holdings: DataFrame, schedule: DataFrame) -> DataFrame:
    """Entries and exits per rebalance: ``(strategy_id, rebalance_no, period_no, symbol, action)``.

    Gold counts as holding nothing.  Gaps-and-islands over (strategy, symbol).
    """
    equity = holdings.where("regime = 'equity'").select("strategy_id", "symbol", "rebalance_no")
    w = Window.partitionBy("strategy_id", "symbol").orderBy("rebalance_no")
    marked = equity.withColumns(
        {"_prev": F.lag("rebalance_no").over(w), "_next": F.lead("rebalance_no").over(w)}
    )
    entries = marked.where("_prev IS NULL OR _prev < rebalance_no - 1").select(
        "strategy_id", "symbol", "rebalance_no", F.lit("entry").alias("action")
    )
    exits = marked.where("_next IS NULL OR _next > rebalance_no + 1").select(
        "strategy_id", "symbol", (F.col("rebalance_no") + 1).alias("rebalance_no"), F.lit("exit").alias("action")
    )
    # an exit one past the last rebalance has not happened: the name is still held
    return entries.unionByName(exits).join(
        schedule.select("strategy_id", "rebalance_no", "period_no"), ["strategy_id", "rebalance_no"]
    )


def holdings_events(holdings: DataFrame, schedule: DataFrame, since=None, freq: str = "month") -> DataFrame:
    """Dated entry/exit events, optionally only those on or after ``since`` (column or date)."""
    out = holding_changes(holdings, schedule).select(
        "strategy_id", c.period_end_of("period_no", freq).alias("event_date"), "symbol", "action"
    )
    return out if since is None else out.where(F.col("event_date") >= F.lit(since).cast("date"))


def current_positions(holdings: DataFrame, schedule: DataFrame, freq: str = "month") -> DataFrame:
    """Names held after the last rebalance with the start of their unbroken streak."""
    entered = current_entries(holdings, schedule)
    return entered.select("strategy_id", "symbol", c.period_end_of("entry_period", freq).alias("entry_date"))


def current_entries(holdings: DataFrame, schedule: DataFrame) -> DataFrame:
    """Names held after the last rebalance with the period that began their unbroken streak: ``(strategy_id, symbol, entry_period)``."""
    last = schedule.groupBy("strategy_id").agg(
        F.max("rebalance_no").alias("_last"), F.max_by(F.struct("period_no", "regime"), "rebalance_no").alias("_at")
    )
    entries = (
        holding_changes(holdings, schedule)
        .where("action = 'entry'")
        .groupBy("strategy_id", "symbol")
        .agg(F.max("period_no").alias("_entry"))
    )
    held = holdings.join(last, "strategy_id").where("rebalance_no = _last")
    gold = F.col("_at.regime") == "gold"
    return held.join(entries, ["strategy_id", "symbol"], "left").select(
        "strategy_id", "symbol", F.when(gold, F.col("_at.period_no")).otherwise(F.col("_entry")).alias("entry_period")
    )
