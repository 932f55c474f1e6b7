"""Registered queries: each one pairs a Spark job with its SQL oracle."""

from __future__ import annotations

import importlib

MODULES = ("sources_to_records", "volume", "fleet_config", "log_search", "fleet_state", "delivery")


def load():
    """All queries and oracles, by name."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
