"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

import importlib

from tagloom.plans import registry

MODULES = ["score_queries", "prompt_queries", "catalog_queries", "image_queries", "file_queries", "metadata_queries", "tensor_queries", "stream_queries"]


def load():
    """Import every query module once and return the registry."""
    for module in MODULES:
        importlib.import_module(f"tagloom.plans.{module}")
    return registry
