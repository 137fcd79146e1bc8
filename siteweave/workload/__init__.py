"""Queries over the given tables, one per operator."""

from __future__ import annotations

from importlib import import_module

MODULES = ["boxes", "rulesets", "spatial_q", "plans_q", "cuboid_q", "intake_q", "checks_q", "versions_q", "files_q", "documents_q"]


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_queries():
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from .registry import ORACLES

    _load()
    return dict(ORACLES)
