"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The lambda variable keeps the optimizer from copying a large expression
    into every place that uses it, and keeps inner lambdas from computing it
    again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
