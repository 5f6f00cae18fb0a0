"""Scored person records for chosen areas: filter, dwelling attributes, scale, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import numbers, scoring
from tallystone.operators.shape import area_codes, decode, select_present
from tallystone.operators.skew import salted_join

# Column names of the census file.
DWELLING = ["idep", "iprov", "imun", "i00"]
PERSON = [*DWELLING, "p24_parentes", "p25_sexo", "p26_edad", "idioma_mat", "p32_pueblo_per", "p32_pueblos",
          "p331_idiohab1_cod", "p332_idiohab2_cod", "p333_idiohab3_cod", "p341_idiomat_cod"]
# Age groups, closed on the left.
AGE_BREAKS, AGE_LABELS = [0, 15, 30, 45, 60], ["0-14", "15-29", "30-44", "45-59", "60+"]
AREA_KIND = {"urban": 1, "rural": 2}


def in_area(codes: Sequence[str]) -> Column:
    """Rows of the areas named by 2-, 4- or 6-digit codes, on the integer code columns.

    The department set comes first and alone, which lets the scan skip the
    partitions of all other departments.
    """
    parts = [[int(c[i:i + 2]) for i in range(0, len(c), 2)] for c in area_codes(codes)]
    exact = F.lit(False)
    for p in parts:
        one = F.lit(True)
        for name, value in zip(DWELLING, p):
            one = one & (F.col(name) == value)
        exact = exact | one
    return F.col("idep").isin(sorted({p[0] for p in parts})) & exact


def scored_people(people: DataFrame, dwellings: DataFrame, areas: Sequence[str], person: str,
                  kind: str | None = None, extra: Sequence[str] = (), labels: Mapping[int, str] | None = None) -> DataFrame:
    """People of the areas with dwelling kind, indicators, level, age group, language label and dwelling key.

    One lazy plan: the filters reach both scans, and the only shuffle is that of
    the dwelling join.
    """
    if kind is not None and kind not in AREA_KIND:
        raise ValueError("kind is urban, rural or None")
    chosen = select_present(people, [person, *PERSON, *extra]).where(in_area(areas))
    homes = dwellings.select(*DWELLING, "urbrur").where(in_area(areas))
    if kind is not None:
        homes = homes.where(F.col("urbrur") == AREA_KIND[kind])
    joined = salted_join(chosen, homes, DWELLING, [person], "left" if kind is None else "inner")
    q = scoring.indicators(F.col("p32_pueblo_per"), F.col("p32_pueblos"),
                           [F.col("p331_idiohab1_cod"), F.col("p332_idiohab2_cod"), F.col("p333_idiohab3_cod")],
                           F.col("p341_idiomat_cod"))
    flagged = joined.withColumns(q)
    return flagged.withColumns({
        "level": scoring.ordinal_scale(*[F.col(c) for c in q]),
        "age_group": numbers.bins(F.col("p26_edad"), AGE_BREAKS, AGE_LABELS),
        "language_label": decode(F.col("idioma_mat"), labels) if labels else F.concat(F.lit("Code "), F.col("idioma_mat").cast("string")),
        "dwelling_key": F.concat_ws("_", *DWELLING)})
