"""Cross-sectional ranking of all instruments, all periods and all strategies in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators.grid import asof_join
from barloom.operators.indicators import PERIODS_PER_YEAR, trailing_high
from barloom.session import materialise


@dataclass(frozen=True)
class RankParams:
    """Ranking part of a strategy's parameters (None switches a filter off)."""

    strategy_id: str = "default"
    lookback: int = 12
    skip: int = 1
    min_price: float = 10.0
    max_volatility_pct: float | None = None
    use_risk_adjusted: bool = False
    max_trailing_return_pct: float | None = None
    max_drawdown_from_52w_high_pct: float | None = None
    use_membership: bool = False
    universe: str | None = None


#: Scores are compared after rounding so that ties are the same on every engine.
SCORE_DIGITS = 9


def rank_universe(
    panel: DataFrame,
    strategies: Sequence[RankParams],
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Eligible instruments per (strategy, period), best first.

    For the first ranks of each cross-section: a bound on ``rank`` prunes every task before the shuffle.  All ranks of very large
    cross-sections are numbered by :func:`rank_whole`, from :func:`score_universe`.
    """
    scored = score_universe(panel, strategies, membership, universes, daily)
    w = Window.partitionBy("strategy_id", "period_no").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "symbol")
    return scored.withColumn("rank", F.row_number().over(w))


def score_universe(
    panel: DataFrame,
    strategies: Sequence[RankParams],
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Eligible instruments per (strategy, period) with their scores.

    ``panel(symbol, period_end, period_no, price)``; ``membership(symbol, start, end)`` with both ends
    inclusive and a NULL end open; ``universes(universe_id, symbol)``; ``daily(symbol, ts, close)`` for
    the trailing-high filter.  Eligible means: positive price at both window ends, last price at least
    ``min_price``, plus the strategy's filters.  Output ``(strategy_id, period_end, period_no, symbol,
    price, mom, volatility, score)``; equal (rounded) scores rank by symbol.

    All look-backs are range frames of one window over (symbol, period_no): the panel is shuffled once
    for any number of strategies.  A strategy's rows are then expanded in place and filtered before
    they are ranked.
    """
    strategies = list(strategies)
    need_vol = any(s.max_volatility_pct is not None or s.use_risk_adjusted for s in strategies)
    need_high = any(s.max_drawdown_from_52w_high_pct is not None for s in strategies)
    base = panel.select("symbol", "period_end", "period_no", "price").where("price IS NOT NULL")

    windows = sorted({(s.lookback, s.skip) for s in strategies})
    base = base.withColumn("_r", c.growth("price", fr.at("price", 1, idx="period_no")))
    measures: dict[str, Column] = {}
    for lookback, skip in windows:
        end = fr.at("price", skip, idx="period_no")
        start = fr.at("price", skip + lookback, idx="period_no")
        measures[f"_mom_{lookback}_{skip}"] = F.when((start > 0) & (end > 0), c.growth(end, start))
        if need_vol:
            dev = fr.over_slots(F.stddev_samp("_r"), 1 - skip - lookback, -skip, idx="period_no")
            measures[f"_vol_{lookback}_{skip}"] = dev * F.sqrt(F.lit(PERIODS_PER_YEAR))
    base = base.withColumns(measures).drop("_r")

    base = base.withColumn("_member", F.lit(True))
    if any(s.use_membership for s in strategies):
        if membership is None:
            raise ValueError("a strategy asks for the membership filter but no membership table was given")
        base = flag_members(base.drop("_member"), membership, "period_end", alias="_member")
    if need_high:
        if daily is None:
            raise ValueError("the trailing-high filter needs daily bars")
        base = base.join(trailing_high(daily, base.select("symbol", "period_end")), ["symbol", "period_end"], "left")
    base = base.withColumn("_universes", F.array().cast("array<string>"))
    if any(s.universe is not None for s in strategies):
        if universes is None:
            raise ValueError("a strategy names a universe but no universe table was given")
        sets = universes.groupBy("symbol").agg(F.collect_set("universe_id").alias("_universes"))
        base = base.drop("_universes").join(sets, "symbol", "left")

    per_strategy = F.array(*[_eligible(s, need_vol, need_high) for s in strategies])
    return base.select(
        "symbol", "period_end", "period_no", "price", F.explode(F.array_compact(per_strategy)).alias("_s")
    ).select("_s.strategy_id", "period_end", "period_no", "symbol", "price", "_s.mom", "_s.volatility", "_s.score")


def rank_whole(scored: DataFrame) -> DataFrame:
    """``scored`` with the exact ``rank`` of every row, a cross-section spread over as many tasks as its size asks for.

    Rows are dealt out in ranges of (strategy, period, score, symbol), so equal scores are divided by symbol; a row ranks among those of its
    cross-section in its range, and the sizes of the ranges before are added.
    """
    by = ["strategy_id", "period_no"]
    order = [F.desc("_key"), F.col("symbol")]
    rows = scored.withColumn("_key", F.round("score", SCORE_DIGITS)).repartitionByRange(*by, *order)
    rows = materialise(rows.withColumn("_range", F.spark_partition_id()))  # the ranges are kept from here on
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    above = sizes.select(*by, "_range", F.coalesce(fr.before(F.sum("_n"), by, "_range"), F.lit(0)).alias("_above"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    placed = placed.join(above, [*by, "_range"])
    return placed.withColumn("rank", (F.col("rank") + F.col("_above")).cast("int")).drop("_key", "_range", "_above")


def _eligible(s: RankParams, need_vol: bool, need_high: bool) -> Column:
    """The strategy's struct for a panel row, NULL when the row is not eligible."""
    mom = F.col(f"_mom_{s.lookback}_{s.skip}")
    vol = F.col(f"_vol_{s.lookback}_{s.skip}") if need_vol else F.lit(None).cast("double")
    ok = mom.isNotNull() & (F.col("price") >= s.min_price)
    if s.use_membership:
        ok &= F.col("_member")
    if s.universe is not None:
        ok &= F.array_contains("_universes", s.universe)
    if s.max_trailing_return_pct is not None:
        ok &= mom <= s.max_trailing_return_pct / 100.0
    if s.max_volatility_pct is not None:
        ok &= vol.isNotNull() & (vol <= s.max_volatility_pct / 100.0)
    score = mom
    if s.use_risk_adjusted:
        ok &= vol.isNotNull() & (vol > 1e-9)
        score = c.ratio(mom, vol)
    if s.max_drawdown_from_52w_high_pct is not None:
        ok &= c.ratio("price", "high_52w") >= 1 - s.max_drawdown_from_52w_high_pct / 100.0
    fields = F.struct(
        F.lit(s.strategy_id).alias("strategy_id"), mom.alias("mom"), vol.alias("volatility"), score.alias("score")
    )
    return F.when(c.holds(ok), fields)


def flag_members(df: DataFrame, membership: DataFrame, day: str = "ts", by: str = "symbol", alias: str = "is_member") -> DataFrame:
    """Was the instrument a member on ``day``?  Both ends inclusive, a NULL end is open.

    Some interval covers the day exactly if the latest end among the intervals begun by then does, so
    the range join is an as-of lookup of a running maximum: rows and intervals are never paired up,
    and overlapping intervals are fine.
    """
    forever = F.lit("9999-12-31").cast("date")
    begun = membership.groupBy(by, F.col("start").alias("_start")).agg(
        F.max(F.coalesce("end", forever)).alias("_end")
    )
    reach = begun.withColumn("_until", fr.running(F.max("_end"), by, "_start"))
    found = asof_join(df, reach, by, ["_until"], ts=day, right_ts="_start")
    return found.withColumn(alias, c.holds(F.col(day) <= F.col("_until"))).drop("matched_ts", "_until")


def members_on(df: DataFrame, membership: DataFrame, day: str = "ts", by: str = "symbol") -> DataFrame:
    """Rows whose instrument was a member on ``day``, see :func:`flag_members`."""
    return flag_members(df, membership, day, by, "_member").where("_member").drop("_member")


def universe_calendar(
    ranking: DataFrame, n: int, weakest: bool = False, allowed: DataFrame | None = None, start=None
) -> DataFrame:
    """The ``n`` best (or worst) names of each period -> adds ``entry_rank`` (1 = first choice).

    ``allowed`` restricts *after* ranking and before the count gate; periods with fewer than ``n``
    names are dropped; ``start`` filters the finished calendar only.
    """
    rows = ranking if allowed is None else ranking.join(allowed.select("symbol").distinct(), "symbol", "left_semi")
    w = Window.partitionBy("strategy_id", "period_no")
    order = F.desc("rank") if weakest else F.col("rank")
    # the rank bound prunes before the shuffle; a period is full if its n-th name is among the n that are left
    best = rows.withColumn("entry_rank", F.row_number().over(w.orderBy(order))).where(F.col("entry_rank") <= n)
    picked = best.withColumn("_n", F.max("entry_rank").over(w)).where(F.col("_n") >= n).drop("_n")
    return picked if start is None else picked.where(F.col("period_end") >= F.lit(start).cast("date"))


def latest_ranked(ranking: DataFrame, last_period_no: int | Column, window: int = 4) -> DataFrame:
    """Ranking of the newest period that ranks anything among the last ``window`` periods."""
    last = F.lit(last_period_no) if isinstance(last_period_no, int) else last_period_no
    recent = ranking.where((F.col("period_no") <= last) & (F.col("period_no") > last - window))
    newest = recent.groupBy("strategy_id").agg(F.max("period_no").alias("period_no"))
    return recent.join(newest, ["strategy_id", "period_no"], "left_semi")


def ranked_table(ranking: DataFrame, names: DataFrame, top_n: int = 10, exit_rank: int = 18) -> DataFrame:
    """Ranking with company name, industry and buy/hold/out zone; unknown names read ``-``."""
    return (
        ranking.join(names.select("symbol", "company", "industry"), "symbol", "left")
        .withColumns(
            {
                "company": F.coalesce("company", F.lit("-")),
                "industry": F.coalesce("industry", F.lit("-")),
                "zone": c.zone_label("rank", top_n, exit_rank),
            }
        )
    )


def needed_symbols(ranking: DataFrame, n: int, start=None) -> DataFrame:
    """Every name that was ever among the first ``n`` since ``start``."""
    rows = ranking.where(F.col("rank") <= n)
    if start is not None:
        rows = rows.where(F.col("period_end") >= F.lit(start).cast("date"))
    return rows.select("symbol").distinct()


def missing_symbols(needed: DataFrame, have: DataFrame) -> DataFrame:
    """Needed minus present: the download list."""
    return needed.select("symbol").distinct().join(have.select("symbol").distinct(), "symbol", "left_anti")


def assign_period(bars: DataFrame, periods: DataFrame, rule: str = "month_start", ts: str = "ts", freq: str = "month") -> DataFrame:
    """Latest universe period in force on each bar -> ``universe_no`` (NULL before the first).

    ``rule='month_start'`` looks from the start of the bar's period, so a bar never sees a universe
    ranked with its own period's close; ``rule='raw'`` compares the day itself with the label, which
    lets a bar on the label's day see the new universe.  Universe periods are spelled out over the
    period numbers they are valid for, which turns the as-of lookup into an equi-join.
    """
    no = c.period_no(ts, freq)
    if rule == "raw":
        on_label = F.col(ts).cast("date") == c.period_end(ts, freq)
        key = F.when(on_label, no).otherwise(no - 1)
    elif rule == "month_start":
        key = no - 1
    else:
        raise ValueError("rule must be 'month_start' or 'raw'")
    keyed = bars.withColumn("_key", key)
    last = keyed.agg(F.max("_key")).scalar()
    by = [k for k in ("strategy_id",) if k in periods.columns]
    w = Window.partitionBy(*by, F.lit(0)).orderBy("universe_no")
    valid = (
        periods.select(*by, F.col("period_no").alias("universe_no"))
        .distinct()
        .withColumn("_until", F.greatest(F.coalesce(F.lead("universe_no").over(w) - 1, last), F.col("universe_no")))
        .withColumn("_key", F.explode(F.sequence("universe_no", "_until")))
        .drop("_until")
    )
    return keyed.join(valid, "_key", "left").drop("_key")
