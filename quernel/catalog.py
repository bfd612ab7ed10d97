"""name -> callable(spark, sf_dir) and name -> SQL of the core queries."""

from __future__ import annotations

import importlib
import pkgutil

from quernel import plans

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _found in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    _module = importlib.import_module(f"quernel.plans.{_found}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
