"""Binding an expression to a name inside another, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for each row; the optimizer would write a plain reference out at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)
