"""The two long flows end to end: scored people of an area, and the facility panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.nulls import cents
from tallystone.operators import census, facilities, panel
from tallystone.plans.shaping import GENERIC_SQL, PAIRS_SQL
from tallystone.registry import query


@query("scored_people", f"""
with pr(g, l) as (values {PAIRS_SQL}),
p as (select o_orderkey person_id, n_regionkey + 1 idep, n_nationkey % 5 + 1 iprov, o_custkey % 3 + 1 imun, o_custkey i00, o_orderkey % 90 age,
  case when o_orderkey % 3 = 0 then 2 else 1 end ident, o_custkey % 60 g, nullif(o_orderkey % 40, 0) l1, nullif(o_custkey % 9, 0) l2, o_orderkey % 12 m
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
v as (select c_custkey i00, case when c_acctbal < 2000 then 2 else 1 end urbrur from customer),
s as (select p.*, urbrur from p join v using (i00) where (idep = 1 or (idep = 2 and iprov = 3) or (idep = 4 and iprov = 1 and imun = 2)) and urbrur = 2),
i as (select *, ident = 1 q1, case when ident = 1 then exists (select 1 from pr where pr.g = s.g and pr.l in (l1, l2)) or (s.g in ({GENERIC_SQL})
    and (coalesce(l1 between 1 and 37 and l1 <> 6, false) or coalesce(l2 between 1 and 37 and l2 <> 6, false)))
  else coalesce(l1 between 1 and 37 and l1 <> 6, false) or coalesce(l2 between 1 and 37 and l2 <> 6, false) end q2,
  m <> 6 q3, coalesce(l1 = 6, false) or coalesce(l2 = 6, false) c from s)
select person_id, urbrur, case when q1 and q2 and q3 and not c then 7.0 when q1 and q2 and q3 then 6.0 when q1 and q2 then 5.0 when q1 and q3 then 4.5
  when q1 then 4.0 when q2 and q3 and not c then 3.0 when q2 and q3 then 2.0 when q2 then 1.0 when q3 then 1.5 else 0.0 end::double "level",
  case when age < 15 then '0-14' when age < 30 then '15-29' when age < 45 then '30-44' when age < 60 then '45-59' else '60+' end age_group,
  case m when 2 then 'Aymara' when 6 then 'Castellano' else 'Code ' || m end language_label,
  idep || '_' || iprov || '_' || imun || '_' || i00 dwelling_key from i
""")
def scored_people(t):
    """Rural people of a department, a province and a municipality with their scale level."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), (F.col("n_regionkey") + 1).alias("idep"), (F.col("n_nationkey") % 5 + 1).alias("iprov"),
        (F.col("c_custkey") % 3 + 1).cast("int").alias("imun"), F.when(F.col("c_acctbal") < 2000, 2).otherwise(1).alias("urbrur"))
    people = t.orders.join(place, "o_custkey").select(
        k.alias("person_id"), "idep", "iprov", "imun", c.alias("i00"), F.lit(1).alias("p24_parentes"), F.lit(1).alias("p25_sexo"),
        (k % 90).cast("int").alias("p26_edad"), (k % 12).cast("int").alias("idioma_mat"), F.when(k % 3 == 0, 2).otherwise(1).alias("p32_pueblo_per"),
        (c % 60).cast("int").alias("p32_pueblos"), F.nullif(k % 40, F.lit(0)).cast("int").alias("p331_idiohab1_cod"),
        F.nullif(c % 9, F.lit(0)).cast("int").alias("p332_idiohab2_cod"), F.lit(None).cast("int").alias("p333_idiohab3_cod"),
        (k % 12).cast("int").alias("p341_idiomat_cod"))
    homes = place.select("idep", "iprov", "imun", F.col("o_custkey").alias("i00"), "urbrur")
    out = census.scored_people(people, homes, ["1", "0203", "040102"], "person_id", "rural", labels={2: "Aymara", 6: "Castellano"})
    return out.select("person_id", "urbrur", "level", "age_group", "language_label", "dwelling_key")


FACILITY_SQL = """
with y as (select distinct l_suppkey s, year(l_shipdate) y from lineitem),
r as (select s, y, 'Facility ' || s || case when y >= 2000 then ' Center' else '' end facility_name, 'Town ' || (s % 9) facility_city, n_name facility_state,
  md5(s::varchar) || case when y % 2 = 0 then ' st' else '' end addr from y join supplier on s = s_suppkey join nation on s_nationkey = n_nationkey),
b as (select min(y) lo, max(y) hi from r),
k as (select facility_name, facility_city, facility_state, any_value(s) s, row_number() over (order by facility_name, facility_city, facility_state) id from r group by 1, 2, 3),
c as (select s, min(id) canonical_id, count(*) n_variants from k group by 1),
n as (select s, arg_max(facility_name, (y, facility_name)) canonical_name, count(distinct y) n_years, min(y) first_seen, max(y) last_seen from r group by 1)
"""


@query("facility_panel", FACILITY_SQL + """
select canonical_id, case when s % 50 = 1 then 'Renamed ' || s else canonical_name end canonical_name, n_variants, cast(n_years as int) n_years,
  cast(first_seen as int) first_seen, cast(last_seen as int) last_seen,
  case when first_seen = lo and last_seen = hi and n_years = hi - lo + 1 then 'continuous' when first_seen = lo and last_seen = hi then 'persistent_gaps'
    when first_seen = lo then 'closed' when last_seen = hi then 'new' else 'transient' end trajectory
from c join n using (s), b
""")
def facility_panel(t):
    """Suppliers as facilities over ship years, their name and address variants linked into one history."""
    s = F.col("l_suppkey")
    active = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("year")).distinct()
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "s_nationkey")
    records = active.join(placed, "l_suppkey").select(
        "year", F.concat(F.lit("Facility "), s.cast("string"), F.when(F.col("year") >= 2000, " Center").otherwise("")).alias("facility_name"),
        F.concat(F.lit("Town "), (s % 9).cast("string")).alias("facility_city"), F.col("n_name").alias("facility_state"),
        F.concat(F.md5(s.cast("string")), F.when(F.col("year") % 2 == 0, " st").otherwise("")).alias("facility_address"),
        F.col("s_nationkey").cast("string").alias("facility_zip"))
    manual = t.supplier.where("s_suppkey % 50 = 1").select(
        F.concat(F.lit("Facility "), F.col("s_suppkey").cast("string")).alias("lookup_name"),
        F.concat(F.lit("Renamed "), F.col("s_suppkey").cast("string")).alias("canonical_name"))
    crosswalk = facilities.link_facilities(records, "year", overrides=manual)
    linked = facilities.attach_canonical(records, crosswalk, ["year", "facility_address"])
    bounds = [linked.agg(f("year")).scalar() for f in (F.max, F.min)]
    history = panel.trajectories(linked, "canonical_id", "year", *bounds)
    names = crosswalk.groupBy("canonical_id").agg(F.min("canonical_name").alias("canonical_name"), F.count("*").alias("n_variants"))
    return history.join(names, "canonical_id").select(
        "canonical_id", "canonical_name", "n_variants", F.col("n_periods").alias("n_years"), "first_seen", "last_seen", "trajectory")


@query("facility_measures", """
with w as (select l_suppkey, sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'A')::double a, sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'N' and l_linestatus = 'O')::double b,
  sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'R' and l_tax > 0.07)::double c from lineitem group by 1)
select l_suppkey, coalesce(a, 0) + coalesce(b, 0) sum_criminality_levels, coalesce(c, 0) sum_threat_levels,
  round((a + b) / nullif(coalesce(a, 0) + coalesce(b, 0), 0), 6) share_non_crim, round(c / nullif(coalesce(c, 0), 0), 6) share_no_threat,
  case l_suppkey % 3 when 0 then 'Jail' when 1 then 'Private Migrant Detention Center' else 'Other' end facility_type_wiki from w
""")
def facility_measures(t):
    """Text columns of one year cleaned, summed by family and classed."""
    q = cents(F.col("l_quantity"))
    flag, part = F.col("l_returnflag"), lambda cond, name: F.sum(F.when(cond, q)).cast("string").alias(name)
    raw = t.lineitem.groupBy("l_suppkey").agg(
        part(flag == "A", "adp_criminality_male_non_crim"), part((flag == "N") & (F.col("l_linestatus") == "O"), "adp_criminality_female_non_crim"),
        part((flag == "R") & (F.col("l_tax") > 0.07), "adp_no_ice_threat_level"))
    kind = F.element_at(F.array(F.lit("IGSA"), F.lit("USMS CDF"), F.lit("Hold")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    out = facilities.derive_measures(facilities.clean_facilities(raw.withColumn("facility_type_detailed", kind)))
    return out.select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "sum_criminality_levels", "sum_threat_levels",
                      F.round("share_non_crim", 6).alias("share_non_crim"), F.round("share_no_threat", 6).alias("share_no_threat"), "facility_type_wiki")
