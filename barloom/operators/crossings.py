"""What trading rules ask of a series, for all its bars at once: where a level is crossed next, which of many possible trades are taken.

* :func:`first_crossing` finds the first bar that reaches a level through a small tree of tables: bars in blocks, blocks in groups, groups of a key,
  each with its extreme.  A question is answered by equi-joins on (key, block), wherever in the series the bar is.
* :func:`two_states` runs an automaton of two states (in, out) whose inputs do not depend on its past, by windows alone.
* :func:`taken` follows the chain of trades that do not overlap over two integers a possible trade.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr

#: Bars in a block, and blocks in a group.
BLOCK = 64
#: Trades noted before they are put away, so that noting one more copies few.
_SHEAF = 64


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n)


def first_crossing(
    asks: DataFrame,
    bars: DataFrame,
    by: Sequence[str],
    level: str,
    value: str,
    above: bool,
    start: str = "idx",
    hit: str = "hit",
    strict: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """``asks`` with ``hit``: the first ``idx`` after ``start`` at which ``value`` is at or above (below) ``level``; NULL if none is.

    ``bars(*by, idx, value)``; rows without a value never cross.  ``strict`` leaves out equality.
    """
    by = list(by)
    best = F.max if above else F.min
    rows = bars.where(F.col(value).isNotNull()).select(*by, F.col("idx").cast("long").alias("_at"), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumns({"_b": _div(F.col("_at"), block), "_g": _div(F.col("_at"), block * block)})

    def nodes(df, parent: list[str], at: str):
        listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_v").alias("v"))))
        return df.groupBy(*by, *parent).agg(listed.alias("_in"), best("_v").alias("_best"))

    blocks = nodes(rows, ["_g", "_b"], "_at")
    groups = nodes(blocks.select(*by, "_g", "_b", F.col("_best").alias("_v")), ["_g"], "_b")
    tops = nodes(groups.select(*by, "_g", F.col("_best").alias("_v")), [], "_g")

    def first(after: Column | None):
        """The first entry of the joined list that crosses, after a position."""
        wanted = F.col(level)

        def crosses(e):
            if strict:
                ok = e["v"] > wanted if above else e["v"] < wanted
            else:
                ok = e["v"] >= wanted if above else e["v"] <= wanted
            return ok if after is None else ok & (e["at"] > after)

        return F.get(F.filter("_in", crosses), 0)["at"]

    def look(df, table, keys: dict[str, str], out: str, after: Column | None):
        """Join the list that ``keys`` name and note its first crossing as ``out``."""
        side = table.select(*[F.col(k).alias(f"_k_{k}") for k in [*by, *keys]], "_in")
        on = [F.col(k) == F.col(f"_k_{k}") for k in by] + [F.col(mine) == F.col(f"_k_{k}") for k, mine in keys.items()]
        found = df.join(side, on, "left").withColumn(out, first(after))
        return found.drop("_in", *[f"_k_{k}" for k in [*by, *keys]])

    at = F.col(start).cast("long")
    out = asks.withColumns({"_own_b": _div(at, block), "_own_g": _div(at, block * block)})
    out = look(out, blocks, {"_b": "_own_b"}, "_hit", at)
    out = look(out, groups, {"_g": "_own_g"}, "_near", F.col("_own_b"))
    out = look(out, tops, {}, "_far", F.col("_own_g"))
    # further down only where nothing nearer was found
    out = out.withColumn("_far", F.when(F.col("_hit").isNull() & F.col("_near").isNull(), F.col("_far")))
    out = look(out, groups, {"_g": "_far"}, "_there", None)
    out = out.withColumn("_near", F.when(F.col("_hit").isNull(), F.coalesce("_near", "_there")))
    out = look(out, blocks, {"_b": "_near"}, "_down", None)
    out = out.withColumn(hit, F.coalesce("_hit", "_down"))
    return out.drop("_own_b", "_own_g", "_hit", "_near", "_far", "_there", "_down")


def two_states(df: DataFrame, by: Sequence[str], enter: str, leave: str, idx: str = "idx", alias: str = "inside") -> DataFrame:
    """``df`` with ``alias``: is the automaton in before it looks at the row?  Out it obeys ``enter``, in it obeys ``leave``.

    A row where both hold turns it over, whichever state it is in; the state is that of the last row where just one held, turned over as
    often as both held since.
    """
    both, one = F.col(enter) & F.col(leave), F.col(enter) != F.col(leave)
    turned = df.withColumn("_turns", fr.running(F.sum(both.cast("int")), by, idx))
    told = F.when(one, F.struct(F.col(enter).alias("state"), F.col("_turns").alias("turns")))
    turned = turned.withColumns(
        {"_told": fr.before(F.last(told, ignorenulls=True), by, idx), "_seen": fr.before(F.last("_turns"), by, idx)}
    )
    odd = (F.coalesce("_seen", F.lit(0)) - F.coalesce("_told.turns", F.lit(0))) % 2 == 1
    return turned.withColumn(alias, F.coalesce("_told.state", F.lit(False)) != odd).drop("_turns", "_told", "_seen")


def taken(possible: DataFrame, by: Sequence[str], start: str = "idx", end: str = "out") -> DataFrame:
    """The rows of ``possible`` that are taken one after the other: the first, then each first one at or after the end of the last.

    A row without an end is the last one taken.  The fold sees two integers a row, inside one expression for a key.
    """
    by = list(by)
    pair = F.struct(F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"))
    paths = possible.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("_path"))
    none = F.array().cast("array<bigint>")
    begin = F.struct(F.lit(-(2**62)).cast("long").alias("free"), none.alias("cur"), F.array().cast("array<array<bigint>>").alias("all"))

    def step(s, x):
        take = x["a"] >= s["free"]
        full = take & (F.size(s["cur"]) >= _SHEAF)
        grown = F.when(full, F.array(x["a"])).when(take, F.array_append(s["cur"], x["a"])).otherwise(s["cur"])
        return F.struct(
            F.when(take, F.coalesce(x["b"], F.lit(2**62).cast("long"))).otherwise(s["free"]).alias("free"),
            grown.alias("cur"),
            F.when(full, F.array_append(s["all"], s["cur"])).otherwise(s["all"]).alias("all"),
        )

    done = paths.select(*by, F.aggregate("_path", begin, step, lambda s: F.flatten(F.array_append(s["all"], s["cur"]))).alias("_taken"))
    picked = done.select(*by, F.explode("_taken").alias(start))
    return possible.withColumn(start, F.col(start).cast("long")).join(picked, [*by, start], "left_semi")


def next_events(events: DataFrame, by: Sequence[str], columns: Sequence[str], idx: str = "idx") -> DataFrame:
    """``events`` with ``next_<column>`` of the following one of the same key."""
    w = Window.partitionBy(*by).orderBy(idx)
    return events.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
