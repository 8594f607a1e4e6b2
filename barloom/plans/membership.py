"""Membership calendar from an event log, master files and snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import membership as m


@dataclass
class Membership:
    events: DataFrame
    intervals: DataFrame
    report: DataFrame
    unresolved: DataFrame


def build_membership(
    log: DataFrame, aliases: DataFrame, canon: DataFrame, snapshots: DataFrame, cutoff: float = 0.88
) -> Membership:
    """``log(date, name, action)`` + ``snapshots(as_of, symbol)`` -> events, intervals and a resolution report.

    Names are resolved to symbols, intervals the earliest snapshot disproves are closed, later changes
    come from the snapshots (canonical symbols), and the whole log is collapsed to intervals.
    """
    resolved = m.resolve_names(log, aliases, cutoff)
    official = resolved.where("symbol IS NOT NULL").select(
        "date", "symbol", "action", F.lit("index_log").alias("source")
    )
    checkpoints = m.apply_canon(snapshots.select("as_of", "symbol"), canon)
    events = official.unionByName(m.snapshot_diff(checkpoints)).unionByName(
        m.reconcile_with_snapshot(official, snapshots, canon)
    )
    return Membership(events, m.collapse_intervals(events), m.resolution_report(resolved), m.unresolved_names(resolved))
