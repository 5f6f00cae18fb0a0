"""Missing-value rules where the workload differs from plain SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_set(col: Column, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a NULL input."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in_set(col: Column, values: Iterable) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~in_set(col, values)


def strict_sum(col: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(~F.bool_or(col.isNull()), F.sum(col))


def cents(col: Column) -> Column:
    """Two-decimal money as an exact decimal, so sums do not depend on task order."""
    return col.cast("decimal(18,2)")


def exact_sum(col: Column) -> Column:
    return F.sum(cents(col)).cast("double")


def row_sum(cols: Iterable[Column]) -> Column:
    """Sum across columns of a row, ignoring NULLs (0 when all are NULL)."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols], F.lit(0))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def same_key(left: Column, right: Column) -> Column:
    """Key equality in which a missing key matches a missing key."""
    return left.eqNullSafe(right)
