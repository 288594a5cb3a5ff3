"""Evaluate an expression once per row and use it many times inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

__all__ = ["let"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Spark folds a column that is used once into its user. If that use is inside a lambda, the folded
    expression would run for every element; a lambda variable bound outside cannot be folded.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
