"""Registry of named queries: Spark plan + DuckDB oracle text.

Each entry reads the driver tables (through the fixture views) so its work grows
with them. ``sql`` is None for operators without a faithful SQL form; those get a
row-count check plus brute-force tests on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from cadence.sources.fixtures import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ("txn",)):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module (each registers on import)."""
    import importlib
    import pkgutil

    import cadence.plans as pkg

    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("catalog_"):
            importlib.import_module(f"cadence.plans.{m.name}")
