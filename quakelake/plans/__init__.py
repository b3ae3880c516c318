"""Named queries over the given tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["catalog_plans", "text_plans", "retrieval_plans", "wave_plans", "stream_plans"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries():
    from quakelake.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from quakelake.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
