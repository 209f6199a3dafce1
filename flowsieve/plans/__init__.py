"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from flowsieve.plans.base import REGISTRY, Query

MODULES = (
    "flow_queries",
    "prepare_queries",
    "score_queries",
    "alert_queries",
    "vector_queries",
    "stream_queries",
    "io_queries",
)


def catalog() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"flowsieve.plans.{name}")
    return REGISTRY
