"""Registered queries with their SQL oracles, grouped by family."""

from __future__ import annotations

import importlib

from hydrolake.catalog.registry import REGISTRY, Query

FAMILIES = ["series_queries", "rollup_queries", "space_queries", "risk_queries", "training_queries", "model_queries", "stream_queries"]


def load() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"hydrolake.catalog.{family}")
    return REGISTRY
