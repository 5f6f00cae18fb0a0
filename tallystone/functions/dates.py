"""Dates from serial numbers and mixed text; eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def serial_date(col: Column) -> Column:
    """Spreadsheet day number in a text column as a date; other text gives NULL."""
    digits = F.when(col.rlike("^[0-9]+$"), col).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), digits)


def not_serial(col: Column) -> Column:
    """The text that is not a day number, for the companion column."""
    return F.when(~col.rlike("^[0-9]+$"), col)


def first_date(col: Column, formats: Sequence[str]) -> Column:
    """The first of several formats that reads the text."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)).cast("date") for f in formats])


def shift_century(date: Column, wrong: Column, centuries: int = 1) -> Column:
    """Repair of two-digit years: move the date by whole centuries where it reads wrong."""
    return F.when(wrong, F.add_months(date, 1200 * centuries)).otherwise(date)


def era(date: Column, starts: Sequence[tuple[str, str]]) -> Column:
    """Label of the latest era start not after the date; starts are given latest first."""
    out = F.when(date >= F.lit(starts[0][0]).cast("date"), starts[0][1])
    for start, label in starts[1:]:
        out = out.when(date >= F.lit(start).cast("date"), label)
    return out
