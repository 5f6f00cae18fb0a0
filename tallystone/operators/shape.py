"""Renaming, casting, decoding, splitting and reshaping of rows and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.nulls import row_sum
from tallystone.functions.text import snake_case, snake_name
from tallystone.operators.aggregate import categories
from tallystone.operators.ordered import forward_fill


def rename(df: DataFrame, new_from_old: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def snake_case_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(c) for c in df.columns])


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist; absent ones are no error."""
    return df.select(*[c for c in columns if c in df.columns])


def cast_and_round(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Numbers rounded half-even, NULL where the text is no number; other columns become text."""
    return df.select(*[
        F.bround(F.col(c).try_cast("double"), digits).alias(c) if c in columns else F.col(c).cast("string").alias(c)
        for c in df.columns])


def prefix_sum(df: DataFrame, prefix: str, out: str) -> DataFrame:
    return df.withColumn(out, row_sum([F.col(c) for c in df.columns if c.startswith(prefix)]))


def decode(col: Column, labels: Mapping[object, str], fallback: str = "Code ") -> Column:
    """Code to label with a literal map; unknown codes read ``Code n``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    known = F.try_element_at(table, col)
    return F.coalesce(known, F.concat(F.lit(fallback), col.cast("string")))


def decode_by_table(df: DataFrame, code: str, table: DataFrame, table_code: str, label: str, out: str) -> DataFrame:
    """The same through a label table of any size; Spark chooses the join by its size."""
    t = table.select(F.col(table_code).alias("_code"), F.col(label).alias(out))
    joined = df.join(t, F.col(code) == F.col("_code"), "left").drop("_code")
    return joined.withColumn(out, F.coalesce(out, F.concat(F.lit("Code "), F.col(code).cast("string"))))


def zap_missing(df: DataFrame, codes: Mapping[str, Sequence[int]], labels: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Missing-answer codes to NULL, and a label column beside each code column."""
    clean = df.withColumns({c: F.when(F.col(c).isin(list(v)), None).otherwise(F.col(c)) for c, v in codes.items()})
    return clean.withColumns({f"{c}_label": F.when(F.col(c).isNotNull(), decode(F.col(c), m)) for c, m in labels.items()})


def area_codes(codes: Sequence[str]) -> list[str]:
    """Codes as text of 2, 4 or 6 digits; a single digit gets a zero in front, nothing else does."""
    padded = [str(c).zfill(2) for c in codes]
    if any(len(c) not in (2, 4, 6) or not c.isdigit() for c in padded):
        raise ValueError("area codes have 2, 4 or 6 digits")
    return padded


def in_areas(geo: Column, codes: Sequence[str]) -> Column:
    """Filter on codes of mixed length: 2, 4 or 6 digits name nested areas.

    A plain OR of prefix sets, which the scan can evaluate; nothing is joined.
    """
    padded = area_codes(codes)
    keep = F.lit(False)
    for n in (2, 4, 6):
        level = [c for c in padded if len(c) == n]
        if level:
            keep = keep | F.substring(geo, 1, n).isin(level)
    return F.coalesce(keep, F.lit(False))


def expand_counts(df: DataFrame, count: str, out: str = "unit") -> DataFrame:
    """One row per counted unit, numbered from 1; zero and NULL give none."""
    n = F.col(count).cast("int")
    return df.where(n > 0).withColumn(out, F.explode(F.sequence(F.lit(1), n)))


def simplify_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Array columns that never hold more than one value become scalars."""
    sizes = df.agg(*[F.max(F.size(c)).alias(c) for c in columns]).first()
    single = [c for c in columns if (sizes[c] or 0) <= 1]
    return df.withColumns({c: F.get(F.col(c), F.lit(0)) for c in single})


def expand_slots(df: DataFrame, key: str, items: str, lookup: DataFrame, lookup_key: str,
                 attributes: Sequence[str], slots: int | None = None, prefix: str = "slot", limit: int = 100) -> DataFrame:
    """Array elements as columns by position, each with its attributes from ``lookup``.

    The longest array sets the number of columns. Arrays longer than ``slots`` (or than ``limit``, without it) are an error.
    """
    longest = df.agg(F.max(F.size(items))).first()[0] or 0
    if longest > (limit if slots is None else slots):
        raise ValueError(f"{items} has arrays of {longest} elements")
    slots = max(longest, 1) if slots is None else slots
    exploded = df.select(key, F.posexplode(items).alias("_pos", lookup_key))
    known = exploded.join(lookup, lookup_key, "left")
    aggs = []
    for i in range(slots):
        here = F.col("_pos") == i
        for c in [lookup_key, *attributes]:
            aggs.append(F.max(F.when(here, F.col(c))).alias(f"{prefix}_{i + 1}_{c}"))
    wide = known.groupBy(key).agg(*aggs)
    return df.drop(items).join(wide, key, "left")


def route_slots(df: DataFrame, key: str, items: str, lookup: DataFrame, lookup_key: str, kind: str,
                routes: Mapping[str, str]) -> DataFrame:
    """Array elements to columns by the kind the lookup gives them (``kind -> column``); the first of a kind wins."""
    known = df.select(key, F.posexplode(items).alias("_pos", lookup_key)).join(lookup, lookup_key, "inner")
    wide = known.groupBy(key).agg(*[
        F.min_by(lookup_key, F.when(F.col(kind) == k, F.col("_pos"))).alias(c) for k, c in routes.items()])
    return df.drop(items).join(wide, key, "left")


# Long header groups and their short names.
HEADER_GROUPS = [
    ("Facility Information", "Facility"), ("ADP Detainee Classification Level", "ADP Detainee Classification"),
    ("ADP Detainee Security Level", "ADP Detainee Security"), ("ADP ICE Threat Level", "ADP"), ("ADP Mandatory", "ADP"),
    ("Contract Facility Inspections Information", "Inspections"),
]


def header_names(df: DataFrame, pos: str, upper: str, lower: str,
                 groups: Sequence[tuple[str, str]] = HEADER_GROUPS, facility_hint: str = "This list") -> DataFrame:
    """Column names from a two-row header: fill right, drop year tags, shorten groups, join, snake case."""
    filled = forward_fill(df.select(pos, upper, lower), [], [F.col(pos).asc()], {"_group": F.col(upper)})

    def tidy(c: Column) -> Column:
        return F.replace(F.trim(F.regexp_replace(c, r"FY\d\d", "")), F.lit(":"), F.lit(""))

    top = tidy(F.col("_group"))
    short = F.when(top.contains(facility_hint), "Facility")
    for long_name, name in groups:
        short = short.when(top == long_name, name)
    joined = F.concat_ws(" ", short.otherwise(top), tidy(F.col(lower)))
    return filled.select(pos, snake_case(joined).alias("var_name"))


def label_sections(df: DataFrame, order: Sequence[Column], header: Column, label: Column, out: str) -> DataFrame:
    """Carry the label of the last header row down to the rows under it."""
    return forward_fill(df, [], order, {out: F.when(header, label)})


def split_sections(df: DataFrame, section: str, shared: Column, sections: Sequence[str] | None = None, limit: int = 1000) -> DataFrame:
    """Sub-tables by section, each of them also keeping the shared (total, tail) rows.

    Without ``sections`` all of the data, ``limit`` at most.
    """
    if sections is None:
        sections = categories(df, section, limit)
    target = F.when(shared, F.array(*[F.lit(s) for s in sections])).otherwise(F.array(F.col(section)))
    return df.withColumn(section, F.explode(target)).where(F.col(section).isin(list(sections)))
