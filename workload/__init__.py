"""Queries over the test tables, one per operator, each with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ("q_sources", "q_calendar", "q_momentum", "q_portfolio", "q_signals", "q_flows", "q_membership", "q_maintenance")


def load():
    """``(queries, oracle SQL)`` of all query modules."""
    from workload import registry

    for m in MODULES:
        importlib.import_module(f"workload.{m}")
    return registry.QUERIES, registry.ORACLES
