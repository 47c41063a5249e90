"""Importing this module registers every query."""

from __future__ import annotations

import importlib

from tickloom.plans.registry import COVERS, QUERIES, oracle_texts

FLAGSHIP = "screen_universe"

for _name in ("scan_queries", "panel_queries", "pattern_queries", "validation_queries", "screen_queries", "fundamental_queries", "flow_queries", "evidence_queries", "audit_queries", "dual_queries", "theme_queries"):
    importlib.import_module(f"tickloom.plans.{_name}")

__all__ = ["COVERS", "FLAGSHIP", "QUERIES", "oracle_texts"]
