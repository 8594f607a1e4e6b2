"""Incremental maintenance of bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str] = ("symbol", "ts"), prefer: str = "fresh") -> DataFrame:
    """Merge two tables on ``keys``; on a shared key ``prefer`` decides which whole row stays.

    ``existing`` holds one row per key, as every upsert leaves it; duplicates in ``fresh`` are resolved by the largest
    row, so the result does not depend on arrival order and applying the same input twice changes nothing.
    Only ``fresh`` is sorted; the losing side is thinned by an anti join on its keys, and a stored table partitioned by
    time needs to be read for the partitions of ``fresh`` only.
    """
    if prefer not in ("fresh", "existing"):
        raise ValueError("prefer must be 'fresh' or 'existing'")
    keys, cols = fr.keys_of(keys), existing.columns
    new = keep_last(fresh.select(*cols), keys)
    win, lose = (existing, new) if prefer == "existing" else (new, existing)
    rest = lose.join(win.select(*keys), keys, "left_anti")
    return win.select(*cols).unionByName(rest.select(*cols))


def keep_last(df: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """One row per key, the one with the highest ``seq`` (ties, or without ``seq``: the largest row).

    A row number of which only the first counts: each task keeps one row per key before the shuffle.
    """
    rest = [x for x in df.columns if x not in keys and x != seq]
    order = ([F.col(seq).desc()] if seq else []) + [F.col(x).desc() for x in rest]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth") if order else df.distinct()


def splice(first: DataFrame, second: DataFrame, cutoff, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """``first`` before ``cutoff``, and ``second`` wherever ``first`` (cut) has no row of its own."""
    head = first.where(F.col(ts) < F.lit(cutoff).cast("date"))
    tail = second.join(head.select(by, ts).distinct(), [by, ts], "left_anti")
    return head.select(second.columns).unionByName(tail)


def coverage_report(existing: DataFrame, older: DataFrame, target, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Backfill status per instrument: ``already_covered``, ``backfilled`` or ``no_older_data``.

    ``older`` holds what a backfill request returned.
    """
    have = existing.groupBy(by).agg(F.min(F.col(ts).cast("date")).alias("earliest"))
    got = older.groupBy(by).agg(F.count("*").alias("_n"))
    status = (
        F.when(F.col("earliest") <= F.lit(target).cast("date"), "already_covered")
        .when(F.coalesce("_n", F.lit(0)) > 0, "backfilled")
        .otherwise("no_older_data")
    )
    return have.join(got, by, "left").select(by, "earliest", status.alias("status"))
