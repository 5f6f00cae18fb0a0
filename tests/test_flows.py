"""The facility and census flows on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tallystone.operators import aggregate, census, facilities

COLS = "year string, facility_name string, facility_city string, facility_state string, facility_address string, facility_zip string"
ROWS = [
    ("FY23", "Alpha Jail", "Town", "TX", "100 Long Street Road", "123"),
    ("FY24", "Alpha Center", "Town", "TX", "100 Long Streets Road", "00123"),
    ("FY24", "Beta Annex", "Town", "TX", "104 Long Street Road", "00123"),
    ("FY25", "Gamma", "Else", "NM", "9 Other Way Entirely", "00777"),
    ("FY25", "Gamma Two", "Else", "NM", "9 OTHER  WAY ENTIRELY", "00777"),
    ("FY25", "No Address", "Else", "NM", None, "00777"),
]


def test_linking_and_exclusions(spark):
    df = spark.createDataFrame(ROWS, COLS)
    cross = {r.facility_name: r for r in facilities.link_facilities(df, "year").collect()}
    assert cross["Alpha Jail"].canonical_id == cross["Alpha Center"].canonical_id == cross["Beta Annex"].canonical_id
    assert cross["Gamma"].canonical_id == cross["Gamma Two"].canonical_id != cross["No Address"].canonical_id
    barred = spark.createDataFrame([("Beta Annex", "Alpha Jail"), ("Alpha Center", "Beta Annex")], "name_a string, name_b string")
    manual = spark.createDataFrame([("Alpha Jail", "Alpha (Texas)")], "lookup_name string, canonical_name string")
    cross = {r.facility_name: r for r in facilities.link_facilities(df, "year", barred, manual).collect()}
    assert cross["Alpha Jail"].canonical_id == cross["Alpha Center"].canonical_id != cross["Beta Annex"].canonical_id
    assert {cross[n].canonical_name for n in ("Alpha Jail", "Alpha Center")} == {"Alpha (Texas)"}
    assert cross["Beta Annex"].canonical_name == "Beta Annex"


def test_cleaning(spark):
    df = spark.createDataFrame([("adams co. det ctr", "MCFARLAND", "12.26", "x", "Pre-Occupancy", "5.0")],
                               "facility_name string, facility_city string, adp_mandatory string, facility_zip string, "
                               "inspections_last_inspection_type string, inspections_guaranteed_minimum string")
    r = facilities.clean_facilities(df).first()
    assert (r.facility_city, r.adp_mandatory, r.inspections_last_inspection_type, r.inspections_guaranteed_minimum) == ("McFarland", 12.3, "PREOCC", 5)


def test_area_codes_reach_the_scan(spark, tmp_path):
    rows = [(d, p, m, 1) for d in (1, 2, 3) for p in (1, 2) for m in (1, 2)]
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame(rows, "idep int, iprov int, imun int, i00 long").write.partitionBy("idep").parquet(path)
    df = spark.read.parquet(path).where(census.in_area(["1", "0202", "020101"]))
    assert sorted(map(tuple, df.select("idep", "iprov", "imun").collect())) == [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1), (2, 2, 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "idep" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        census.in_area(["123"])
    with pytest.raises(ValueError):
        census.scored_people(df, df, ["1"], "i00", kind="Total")


def test_side_totals(spark):
    df = spark.createDataFrame([("g", "a", 3), ("g", "b", 4), ("g", "c", 5), ("h", "a", 1)], "g string, c string, n long")
    sided = aggregate.diverging(df, "g", "c")
    assert {(r.c, r.side) for r in sided.collect()} == {("a", "left"), ("b", "right"), ("c", "right")}
    totals = {r.g: (r.left_total, r.right_total) for r in aggregate.side_totals(sided, "g").collect()}
    assert totals == {"g": (3, 9), "h": (1, 0)}
    named = aggregate.diverging(df, "g", "c", left=["c"])
    assert {r.c: r.signed for r in named.where(F.col("g") == "g").collect()} == {"a": 3, "b": 4, "c": -5}
