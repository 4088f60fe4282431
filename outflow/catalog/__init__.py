"""Named queries over the given tables, one module per family of the operator inventory."""

import importlib

from outflow.catalog.registry import as_callables, as_sql

MODULES = ["sources_listing", "aggregates", "joins_windows", "features", "evaluation", "workflow", "graphs", "models", "streams"]
for _module in MODULES:
    importlib.import_module(f"outflow.catalog.{_module}")

__all__ = ["as_callables", "as_sql"]
