"""Imports every query family so that the catalog is complete."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("calls", "text", "reads", "placement", "runs", "variants", "jobs", "sources", "recipes")


def load() -> None:
    for name in FAMILIES:
        import_module(f"{__package__}.{name}_queries")
