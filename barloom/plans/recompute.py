"""Recompute every registered strategy in one job and replace its stored results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import strategies as st
from barloom.session import materialise
from barloom.sources.registry import PRICES, mark_computed, with_parameters
from barloom.sources.sinks import replace_keys


@dataclass
class Recomputed:
    events: DataFrame
    positions: DataFrame
    rejected: DataFrame


#: Names of the universe that filters nothing.
WHOLE_MARKET = ("Nifty 500", "all")


def _freq() -> Column:
    return F.when(F.col("p.rebal_freq") == "Weekly", "week").otherwise("month")


def _grid() -> Column:
    return F.concat_ws("|", _freq(), F.coalesce("p.price_col", F.lit("Adj Close")))


def strategy_table(registry: DataFrame) -> DataFrame:
    """The usable rows of a registry as a relation of strategies."""
    of = {
        "lookback": "lookback_months", "skip": "skip_months", "hold": "hold_months", "n": "n_stocks", "min_price": "min_price",
        "max_volatility_pct": "max_volatility_pct", "use_risk_adjusted": "use_risk_adjusted",
        "max_trailing_return_pct": "max_trailing_return_pct", "max_drawdown_from_52w_high_pct": "max_drawdown_from_52w_high_pct",
        "use_membership": "use_membership_filter", "use_regime": "use_regime_filter",
    }
    whole = F.col("p.universe").isin(*WHOLE_MARKET)
    positive = lambda k: F.when(F.col(k) != 0, F.col(k))
    rows = with_parameters(registry).where("valid").select(
        "strategy_id",
        _grid().alias("grid"),
        _freq().alias("freq"),
        *[F.col(f"p.{v}").alias(k) for k, v in of.items()],
        F.when(F.col("p.use_exit_band"), F.col("p.exit_band_pct")).alias("exit_band_pct"),
        F.when(~whole, F.col("p.universe")).alias("universe"),
        positive("p.gold_entry_lookback").alias("gold_entry"),
        positive("p.gold_exit_lookback").alias("gold_exit"),
    )
    return st.relation(rows)


def rejected(registry: DataFrame, panels: dict | None = None) -> DataFrame:
    """Registry rows whose parameters no run could use, or for whose grid there is no panel."""
    rows = with_parameters(registry)
    unusable = ~F.col("valid")
    if panels is not None:
        unusable |= ~_grid().isin(*_by_grid(panels))
    return rows.where(unusable).select("strategy_id", "name")


def _by_grid(panels: dict) -> dict[str, DataFrame]:
    """Panels by the name of grid and price; one given for the grid alone holds adjusted closes."""
    out = {}
    for freq in ("month", "week"):
        for price in PRICES:
            panel = panels.get((freq, price), panels.get(freq) if price == "Adj Close" else None)
            if panel is not None:
                out[f"{freq}|{price}"] = panel
    return out


def recompute_all(
    registry: DataFrame,
    panels: dict[str | tuple[str, str], DataFrame],
    membership: DataFrame | None = None,
    universes: DataFrame | None = None,
    daily: DataFrame | None = None,
    series: DataFrame | None = None,
    event_months: int = 6,
) -> Recomputed:
    """Events of the last ``event_months`` before each strategy's last rebalance, and current positions.

    ``panels`` maps a period grid (``month``, ``week``), or a grid and a price (``("month", "Close")``), to its panel.
    Rows with unusable parameters or without a panel are diverted to ``rejected`` before the job, so one bad
    strategy cannot fail the others.  A registry without usable rows gives empty tables.  Strategies stay rows of a table throughout
    (:mod:`barloom.operators.strategies`): the plan is the same for any number of them, and none passes through the driver.  Strategies with
    the same parameters are simulated once, and each gets the events and positions.
    """
    found = _by_grid(panels)
    if not found:
        raise ValueError("recompute_all needs a panel")
    usable = strategy_table(registry).where(F.col("grid").isin(*found))
    strategies, members = st.shared(usable, list(st.COLUMNS))
    members = members.select("kind", "strategy_id").distinct()
    panel = st.one_panel(found)
    # the counts combine before their shuffle, the ranks are pruned before theirs
    ranking = st.rank_strategies(panel, strategies, membership, universes, daily)
    schedule, held = st.hold_strategies(panel, strategies, ranking, series)
    last = schedule.groupBy("strategy_id", "freq").agg(F.max("period_no").alias("_last"))
    cut = last.select("strategy_id", F.add_months(st.label("_last"), -event_months).alias("_since"))
    events = st.events(held, schedule).join(cut, "strategy_id").where("event_date >= _since")
    return Recomputed(
        st.to_members(events, members).select("strategy_id", "symbol", "event_date", "action"),
        st.to_members(st.positions(held, schedule), members).select("strategy_id", "symbol", "entry_date"),
        rejected(registry, panels),
    )


def store(done: Recomputed, registry: DataFrame, events_path: str, positions_path: str, when) -> DataFrame:
    """Replace the stored events and positions of every strategy that has holdings and return the registry with those stamped.

    A strategy without holdings keeps what it had; one without events in the span loses its old ones.
    """
    positions = materialise(done.positions)
    keys = positions.select("strategy_id").distinct()
    replace_keys(done.events.join(keys, "strategy_id", "left_semi"), events_path, keys=keys)
    replace_keys(positions, positions_path, keys=keys)
    return mark_computed(registry, keys, when)
