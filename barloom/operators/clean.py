"""Repair and cleaning of raw bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.operators import grid
from barloom.operators.crossings import first_crossing, taken
from barloom.session import materialise


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """The ingest rule: NaN and infinities are NULL from here on."""
    return df.withColumns({x: c.no_nan(x) for x in cols})


def repair_spikes(df: DataFrame, value: str = "close", by: str = "symbol", ts: str = "ts", slots=None) -> DataFrame:
    """Replace a one-slot spike that reverts at once by the mean of its neighbours.

    A spike moves by more than 1.5x (or under 2/3) against the previous slot while the product of
    that ratio and the next one is within (0.9, 1.1).  Both neighbouring *calendar* slots must hold
    a price, so genuine gaps are never touched.  ``repaired`` tells which rows changed.
    """
    rows = df if "idx" in df.columns else grid.with_index(df, ts, slots)
    prev, nxt = fr.at(value, 1, by), fr.at(value, -1, by)
    rows = rows.withColumns({"_prev": prev, "_next": nxt})
    jump = c.ratio(value, "_prev")
    back = jump * c.ratio("_next", value)
    spike = c.holds(((jump > 1.5) | (jump < F.lit(2.0) / F.lit(3.0))) & (back > 0.9) & (back < 1.1))
    return (
        rows.withColumn("repaired", spike)
        .withColumn(value, F.when(F.col("repaired"), (F.col("_prev") + F.col("_next")) / 2.0).otherwise(F.col(value)))
        .drop("_prev", "_next")
    )


def repair_crash_runs(
    df: DataFrame,
    value: str = "value",
    by: str = "series_id",
    ts: str = "ts",
    drop_threshold: float = 0.85,
    recover_band: float = 0.03,
) -> DataFrame:
    """Blank and interpolate a run of prices that crashes and then fully reverts on the next print.

    A print below ``drop_threshold`` x the last good price opens a run; the next print at or above it
    closes the run and, when within ``recover_band`` of that good price, the run is put on the
    straight line between the two good prints.  A run that does not revert is kept.  NULL input rows
    are ignored.  Output: ``(by, ts, value, repaired)``.
    """

    # whichever print is good, the next good one is the first that is not below its threshold: a chain of prints
    rows = df.select(by, ts, value).where(F.col(value).isNotNull())
    rows = rows.withColumn("idx", (F.row_number().over(fr.ordered(by, ts)) - 1).cast("long"))
    rows = materialise(rows.withColumn("_least", F.col(value) * drop_threshold))
    chain = materialise(first_crossing(rows, rows, [by], "_least", value, True, hit="_next"))
    good = taken(chain, [by], "idx", "_next")
    good = good.withColumn("_close", F.lead(value).over(fr.ordered(by, "idx")))
    last = F.struct(F.col("idx").alias("at"), F.col(value).alias("value"), F.col("_next").alias("next"), F.col("_close").alias("close"))
    marked = rows.join(good.select(by, "idx", last.alias("_good")), [by, "idx"], "left")
    marked = marked.withColumn("_run", fr.running(F.last("_good", ignorenulls=True), by, "idx"))
    g = lambda name: F.col(f"_run.{name}")
    reverts = c.holds(F.abs(g("close") / g("value") - 1) < recover_band)
    line = g("value") + (g("close") - g("value")) * (F.col("idx") - g("at")) / (g("next") - g("at"))
    repaired = F.col("_good").isNull() & reverts
    return marked.select(by, ts, F.when(repaired, line).otherwise(F.col(value)).alias(value), repaired.alias("repaired"))


def adjust_open(df: DataFrame) -> DataFrame:
    """Put the raw open on the basis of the adjusted close: ``open * adj_close / close``."""
    return df.withColumn("open", F.col("open") * c.ratio("adj_close", "close"))


def require_fields(df: DataFrame, fields: list[str], by: str = "symbol") -> DataFrame:
    """Keep instruments that have at least one value in every one of ``fields``."""
    whole = df.groupBy(by).agg(*[F.count(f).alias(f) for f in fields])
    for f in fields:
        whole = whole.where(F.col(f) > 0)
    return df.join(whole.select(by), by, "left_semi")


def since(df: DataFrame, start, ts: str = "ts") -> DataFrame:
    """Rows on or after ``start``; applied to outputs only, after rankings have had their history."""
    return df.where(F.col(ts) >= F.lit(start).cast("date"))


def clean_symbol_list(df: DataFrame, column: str = "Symbol", exclude: list[str] = ()) -> DataFrame:
    """Trim, drop blanks, header remnants and ``exclude``; one row per symbol."""
    symbol = F.trim(F.col(column))
    out = df.select(symbol.alias("symbol")).where((F.length("symbol") > 0) & (F.upper("symbol") != "SYMBOL"))
    if exclude:
        out = out.where(~F.col("symbol").isin(list(exclude)))
    return out.distinct()
