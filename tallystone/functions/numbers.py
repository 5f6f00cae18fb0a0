"""Numbers to text and back, thresholds and rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_compact(col: Column) -> Column:
    """``1234`` -> ``1.2K``: magnitude only, one decimal, half-even."""
    size = F.abs(col)

    def short(div: float, unit: str) -> Column:
        text = F.bround(size / div, 1).cast("string")
        return F.concat(text, F.lit(unit))

    return F.when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).otherwise(size.cast("string"))


def compact_count(col: Column) -> Column:
    """``1234567`` -> ``1.2M``; a dash for nothing."""
    n = col.cast("double")

    def fixed(x: Column, pattern: str, unit: str) -> Column:
        # half-even on the exact binary value, as C prints it
        return F.concat(F.call_function("format_number", x, F.lit(pattern)), F.lit(unit))

    return (F.when(n.isNull() | (n == 0), F.lit("—"))
            .when(n >= 1e9, fixed(n / 1e9, "0.0", "B"))
            .when(n >= 1e6, fixed(n / 1e6, "0.0", "M"))
            .when(n >= 1e3, fixed(n / 1e3, "0", "K"))
            .otherwise(F.bround(n, 0).cast("long").cast("string")))


def parse_compact(col: Column) -> Column:
    """``1.2M`` -> 1200000; NULL where no number is found."""
    text = F.replace(col, F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"([0-9.]+)\s*([KMBk]?)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text, r"([0-9.]+)\s*([KMBk]?)", 2)
    return number * F.when(unit.isin("k", "K"), 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def with_thousands(col: Column) -> Column:
    return F.format_number(col, 0)


def strip_thousands(col: Column) -> Column:
    return F.replace(col, F.lit(","), F.lit("")).try_cast("long")


def by_thresholds(col: Column, bounds: Sequence[tuple[float, str]], above: str) -> Column:
    """First label whose upper bound exceeds the value; NULL for a NULL value."""
    out = F.when(col < bounds[0][0], bounds[0][1])
    for bound, label in bounds[1:]:
        out = out.when(col < bound, label)
    return out.when(col >= bounds[-1][0], above)


def bins(col: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed intervals; below the first break and NULL give NULL."""
    out = F.when(col.isNull() | (col < breaks[0]), F.lit(None).cast("string"))
    for upper, label in zip(breaks[1:], labels):
        out = out.when(col < upper, label)
    return out if len(labels) < len(breaks) else out.otherwise(labels[-1])


def rescale(col: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] to [to_low, to_high], clamped."""
    x = (col - low) / (high - low) * (to_high - to_low) + to_low
    return F.when(col.isNotNull(), F.greatest(F.lit(float(to_low)), F.least(F.lit(float(to_high)), x)))
