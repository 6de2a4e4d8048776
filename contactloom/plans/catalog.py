"""All registered queries."""

from __future__ import annotations

import importlib

from contactloom.plans.registry import ORACLE, QUERIES

for _module in ("q_contacts", "q_tracks", "q_features", "q_rearrange", "q_stats", "q_sources", "q_model"):
    importlib.import_module(f"contactloom.plans.{_module}")

__all__ = ["ORACLE", "QUERIES"]
