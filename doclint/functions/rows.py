"""Evaluating an expression once inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(expr: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``expr`` once per row and use it several times inside ``fn``."""
    return F.get(F.transform(F.array(expr), fn), F.lit(0))
