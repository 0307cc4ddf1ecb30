"""Binding of the operators to the driver's tables, with SQL statements of the same results."""

from __future__ import annotations


def catalog() -> dict:
    """All registered queries: name -> (callable, SQL text or None)."""
    from hearthline.bindings import registry

    for module in (
        "flow", "scoring", "sensitivity", "validating", "sources", "cleaning", "joining", "aggregating", "places",
    ):
        __import__(f"hearthline.bindings.{module}")
    return registry.QUERIES
