"""Registry of saved strategies: ``(strategy_id, name, parameters JSON, created_at, last_computed_at)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schemas

#: Most strategies that may be saved.
MAX_STRATEGIES = 200
# What the parameters may say (or leave out).
REBALANCING = ("Monthly", "Weekly")
WEIGHTING = ("equal_monthly", "drift")
PRICES = ("Adj Close", "Close")


def list_strategies(registry: DataFrame) -> DataFrame:
    return registry.select("strategy_id", "name", "created_at", "last_computed_at").orderBy("name")


def get_strategy(registry: DataFrame, strategy_id: str) -> DataFrame:
    return registry.where(F.col("strategy_id") == strategy_id)


def with_parameters(registry: DataFrame) -> DataFrame:
    """Parse the JSON parameters; ``valid`` tells whether the ones every run needs are there and all are known."""
    parsed = registry.withColumn("p", F.from_json("parameters", schemas.STRATEGY_PARAMS))
    needed = ("lookback_months", "skip_months", "hold_months", "n_stocks", "min_price")
    ok = F.col("p").isNotNull()
    for f in needed:
        ok &= F.col(f"p.{f}").isNotNull()
    ok &= (F.col("p.lookback_months") > 0) & (F.col("p.skip_months") >= 0)
    ok &= (F.col("p.hold_months") > 0) & (F.col("p.n_stocks") > 0)
    for f, known in (("rebal_freq", REBALANCING), ("weighting_mode", WEIGHTING), ("price_col", PRICES)):
        ok &= F.col(f"p.{f}").isNull() | F.col(f"p.{f}").isin(*known)
    return parsed.withColumn("valid", F.coalesce(ok, F.lit(False)))


def admit(registry: DataFrame, candidates: DataFrame, cap: int = MAX_STRATEGIES) -> DataFrame:
    """Candidates that may be saved: names not taken, first of equal names, up to the cap.

    Adds ``admitted`` and ``reason``.  At most ``cap`` candidates can be admitted, so only that many, the least ids, are
    numbered.
    """
    taken = registry.select("name").distinct().withColumn("_taken", F.lit(True))
    room = F.lit(cap) - registry.agg(F.count("*")).scalar()
    first = candidates.groupBy("name").agg(F.min("strategy_id").alias("_first"))
    rows = candidates.join(taken, "name", "left").join(first, "name")
    rows = rows.withColumn("_fresh", F.col("_taken").isNull() & (F.col("_first") == F.col("strategy_id")))
    least = rows.where("_fresh").select("strategy_id").orderBy("strategy_id").limit(cap)
    ranks = least.agg(F.array_sort(F.collect_list("strategy_id")).alias("_ids")).select(
        F.posexplode("_ids").alias("_pos", "strategy_id")
    )
    out = rows.join(ranks, "strategy_id", "left").withColumn("_room", room)
    full = F.col("_pos").isNull() | (F.col("_pos") >= F.col("_room"))
    reason = F.when(~F.col("_fresh"), "name exists").when(full, "registry full")
    return out.select(*candidates.columns, reason.isNull().alias("admitted"), reason.alias("reason"))


def mark_computed(registry: DataFrame, done: DataFrame, when) -> DataFrame:
    """Stamp the strategies of ``done(strategy_id)`` as recomputed at ``when``."""
    hit = done.select("strategy_id").distinct().withColumn("_done", F.lit(True))
    stamp = F.when(F.col("_done"), F.lit(when).cast("timestamp_ntz")).otherwise(F.col("last_computed_at"))
    return registry.join(hit, "strategy_id", "left").withColumn("last_computed_at", stamp).drop("_done")


def list_events(events: DataFrame, strategy_id: str, since) -> DataFrame:
    """Events of a strategy since a day, newest first."""
    hit = (F.col("strategy_id") == strategy_id) & (F.col("event_date") >= F.lit(since).cast("date"))
    return events.where(hit).select("event_date", "symbol", "action").orderBy(F.desc("event_date"), "symbol")


def list_positions(positions: DataFrame, strategy_id: str) -> DataFrame:
    return positions.where(F.col("strategy_id") == strategy_id).select("symbol", "entry_date").orderBy("symbol")
