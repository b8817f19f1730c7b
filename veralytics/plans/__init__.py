"""Runnable queries, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "sources", "medallion", "scoring", "retrieval", "coverage", "risk", "events", "injection",
    "rootcause", "value", "feedback", "schedule", "streams",
)


def load_all() -> None:
    for area in AREAS:
        import_module(f"veralytics.plans.{area}")
