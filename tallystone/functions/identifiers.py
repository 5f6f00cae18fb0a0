"""Normal forms of publication identifiers as column expressions; null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import fold_accents


def plain_key(col: Column) -> Column:
    """Lower-case ASCII letters and digits of a text, accents folded; null when none is left."""
    return F.nullif(F.regexp_replace(fold_accents(F.lower(col.cast("string"))), "[^a-z0-9]", ""), F.lit(""))


def doi_key(col: Column) -> Column:
    """Letters and digits of a DOI without resolver address, ``doi:`` mark and closing punctuation."""
    bare = F.regexp_replace(F.trim(F.lower(col)), r"^(https?://)?((dx\.)?doi\.org/|doi:\s*)", "")
    return plain_key(bare)


def _weighted(digits: Column, weight: Column, length: int) -> Column:
    """Sum of digit times weight over the first ``length`` places; ``weight`` lists them, X counts ten."""
    def value(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1))
        return F.when(d == "X", 10).otherwise(d.try_cast("int"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0), lambda s, i: s + value(i) * F.get(weight, i))


def isbn13(col: Column) -> Column:
    """The 13 digits of a valid ISBN of 10 or 13 places; null when the form or the check digit is wrong."""
    digits = F.regexp_replace(F.upper(col), "[^0-9X]", "")
    ten = F.array(*[F.lit(w) for w in range(10, 0, -1)])
    thirteen = F.array(*[F.lit(1 + 2 * (i % 2)) for i in range(13)])
    body = F.concat(F.lit("978"), F.substring(digits, 1, 9))
    check = (10 - _weighted(body, thirteen, 12) % 10) % 10
    return (F.when(digits.rlike("^[0-9]{9}[0-9X]$") & (_weighted(digits, ten, 10) % 11 == 0), F.concat(body, check.cast("string")))
            .when(digits.rlike("^97[89][0-9]{10}$") & (_weighted(digits, thirteen, 13) % 10 == 0), digits))


def isbn_key(col: Column) -> Column:
    """Equal for the two forms of one ISBN. A faulty number keeps its letters and digits, so that it equals the same faulty number only."""
    return F.coalesce(isbn13(col), F.concat(F.lit("~"), plain_key(col)))


def year_key(col: Column) -> Column:
    """First four digits in a row of a date text."""
    return F.nullif(F.regexp_extract(col.cast("string"), r"(\d{4})", 1), F.lit(""))
