"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("scans", "sinks", "ranking", "portfolio", "models", "signals", "comparisons", "riskplans", "policies", "factored", "learned", "returnmodels", "evidence", "robustness", "checks")


def load():
    """Import every area once and return (plans, sql)."""
    from crosspanel.plans import registry

    for area in AREAS:
        import_module(f"crosspanel.plans.{area}")
    return registry.PLANS, registry.SQL
