"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("basics", "cleaning", "profiles", "textual", "recommending", "evaluating", "clustering", "streams", "flows")


def load():
    """Imports every query module and returns the filled registry."""
    for name in MODULES:
        importlib.import_module(f"profilerec.catalog.{name}")
    return importlib.import_module("profilerec.catalog.registry")
