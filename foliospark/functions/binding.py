"""Evaluate an expression once inside another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is otherwise evaluated anew for every
    element, which makes cutting a text into windows quadratic in its length.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
