"""Compositions of operators and the registry of checked queries."""

from importlib import import_module

CHECKS = ["checks_tables", "checks_spatial", "checks_text", "checks_search", "checks_models"]


def load_registry():
    """(queries, sql) by name."""
    for name in CHECKS:
        import_module(f"placelens.plans.{name}")
    from placelens.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
