"""From yearly facility tables to a linked panel: clean, derive, link, trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import scoring, text
from tallystone.operators import joins, linkage, pairs, panel, shape
from tallystone.operators.ordered import number_rows
from tallystone.operators.skew import salted_join
from tallystone.session import cut_lineage

NAME = ["facility_name", "facility_city", "facility_state"]
# Columns that hold numbers.
NUMERIC = [
    "facility_average_length_of_stay_alos", "adp_detainee_classification_level_a", "adp_detainee_classification_level_b",
    "adp_detainee_classification_level_c", "adp_detainee_classification_level_d", "adp_criminality_male_crim",
    "adp_criminality_male_non_crim", "adp_criminality_female_crim", "adp_criminality_female_non_crim", "adp_ice_threat_level_1",
    "adp_ice_threat_level_2", "adp_ice_threat_level_3", "adp_no_ice_threat_level", "adp_mandatory",
]


def clean_facilities(df: DataFrame) -> DataFrame:
    """Typed numbers, one spelling of inspection types, cleaned names and places."""
    typed = shape.cast_and_round(df, [c for c in NUMERIC if c in df.columns])
    fixes = {"facility_name": text.clean_facility_name, "facility_city": text.clean_city_name,
             "facility_address": text.title_case, "facility_male_female": text.title_case}
    out = typed.withColumns({c: f(F.col(c)) for c, f in fixes.items() if c in df.columns})
    if "inspections_guaranteed_minimum" in df.columns:
        out = out.withColumn("inspections_guaranteed_minimum", F.col("inspections_guaranteed_minimum").try_cast("double").cast("int"))
    kind = "inspections_last_inspection_type"
    if kind in df.columns:
        out = out.withColumn(kind, F.when(F.col(kind).isin("PRE-OCCUPANCY", "Pre-Occupancy"), "PREOCC").otherwise(F.col(kind)))
    return out


def derive_measures(df: DataFrame, types: Sequence[tuple[str, str]] = scoring.FACILITY_TYPES) -> DataFrame:
    """Row sums by column family, shares of them, and the facility type."""
    out = shape.prefix_sum(df, "adp_detainee_classification_level_", "sum_classification_levels")
    out = shape.prefix_sum(out, "adp_criminality_", "sum_criminality_levels")
    threat = [c for c in df.columns if c.startswith(("adp_ice_threat_level_", "adp_no_ice_threat_level"))]
    out = out.withColumn("sum_threat_levels", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in threat), F.lit(0.0)))
    non_crim = F.col("adp_criminality_male_non_crim") + F.col("adp_criminality_female_non_crim")
    return out.withColumns({
        "share_non_crim": F.try_divide(non_crim, F.col("sum_criminality_levels")),
        "share_no_threat": F.try_divide(F.col("adp_no_ice_threat_level"), F.col("sum_threat_levels")),
        "facility_type_wiki": scoring.first_rule(F.coalesce("facility_type_detailed", F.lit("")), types, "Other")})


def _first(column: str) -> Column:
    return F.min_by(column, F.struct("addr_norm", "zip5")).alias(column)


def facility_keys(records: DataFrame) -> DataFrame:
    """One numbered row per exact name, city and state, with its normalised address and ZIP."""
    shaped = records.select(
        *NAME, text.pad_zeros(F.col("facility_zip"), 5).alias("zip5"), F.upper(text.squish(F.col("facility_address"))).alias("addr_norm"))
    keys = shaped.groupBy(*NAME).agg(_first("addr_norm"), _first("zip5"))
    return number_rows(keys, [F.col(c).asc() for c in NAME], "facility_id")


def link_facilities(records: DataFrame, year: str, do_not_merge: DataFrame | None = None,
                    overrides: DataFrame | None = None, min_sim: float = 0.8) -> DataFrame:
    """Crosswalk of every name variant to a canonical id and name.

    Variants of one ZIP whose addresses are nearly equal become one facility,
    unless the pair of names (``name_a, name_b``) is in ``do_not_merge``. The
    canonical name is that of the latest year; ``overrides`` (``lookup_name,
    canonical_name``) replace it for the cluster that holds the name.
    """
    keys = cut_lineage(facility_keys(records))
    placed = keys.where("addr_norm is not null and zip5 is not null")
    # equal addresses: each variant is linked to the least one, not to all others
    heads = placed.groupBy("zip5", "addr_norm").agg(F.min("facility_id").alias("id_a"))
    same = salted_join(placed, heads, ["zip5", "addr_norm"], ["facility_id"]).select("id_a", F.col("facility_id").alias("id_b"))
    near = pairs.edit_similar_pairs(placed, ["zip5"], "addr_norm", min_sim)
    ends = heads.select("zip5", "addr_norm", "id_a")
    for side in "ab":
        near = near.join(ends.withColumnsRenamed({"addr_norm": f"text_{side}", "id_a": f"near_{side}"}), ["zip5", f"text_{side}"])
    edges = same.unionByName(near.select(F.col("near_a").alias("id_a"), F.col("near_b").alias("id_b"))).where("id_a <> id_b")
    if do_not_merge is not None:
        names = keys.select("facility_id", "facility_name")
        barred = do_not_merge.join(names.withColumnsRenamed({"facility_id": "x", "facility_name": "name_a"}), "name_a").join(
            names.withColumnsRenamed({"facility_id": "y", "facility_name": "name_b"}), "name_b")
        edges = joins.without_pairs(edges, "id_a", "id_b", barred, "x", "y")
    clusters = linkage.entity_map(keys, "facility_id", edges, "id_a", "id_b")
    crosswalk = cut_lineage(keys.select("facility_id", *NAME).join(clusters, "facility_id"))
    latest = records.groupBy(*NAME).agg(F.max(year).alias(year))
    keyed = latest.join(crosswalk, NAME)
    names = linkage.canonical_names(keyed, "canonical_id", [year, *NAME], {
        "facility_name": "canonical_name", "facility_city": "canonical_city", "facility_state": "canonical_state"})
    if overrides is not None:
        found = overrides.join(crosswalk.select("canonical_id", F.col("facility_name").alias("lookup_name")), "lookup_name")
        names = panel.patch_rows(names, found.drop("lookup_name").distinct(), ["canonical_id"])
    # saved as a table of its own: it is the product the later steps join
    return cut_lineage(salted_join(crosswalk, names, ["canonical_id"], ["facility_id"]))


def attach_canonical(records: DataFrame, crosswalk: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    return salted_join(records, crosswalk.select(*NAME, "canonical_id", "canonical_name"), NAME, spread_by, "left")
