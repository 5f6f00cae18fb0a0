"""Household links and transmission, with customers as dwellings and orders as people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import aggregate, household
from tallystone.operators.skew import salted_join
from tallystone.registry import query

PEOPLE_SQL = """
with p as (select o_orderkey id, o_custkey dw, cast(o_orderkey % 11 + 1 as int) rel, o_orderkey % 83 age, cast(o_orderkey % 8 as int) lev,
  'L' || (o_custkey + o_orderkey // 7) % 4 lang, n_regionkey area
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
rule(c, a) as (values (3, 1), (3, 2), (4, 1), (4, 2), (6, 3), (6, 4), (6, 5), (1, 9)),
ch as (select * from p where age < 18), ad as (select * from p where age >= 18),
k as (select ch.id, ch.rel, ch.lev, ch.lang own, ch.area, ad.lev plev, ad.lang plang from ch join rule on ch.rel = rule.c
  join ad on ad.dw = ch.dw and ad.rel = rule.a)
"""


def _people(t):
    k = F.col("o_orderkey")
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("area"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    return salted_join(orders, homes.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], ["o_orderkey"]).select(
        k.alias("id"), F.col("o_custkey").alias("dw"), (k % 11 + 1).cast("int").alias("rel"), (k % 83).alias("age"),
        (k % 8).cast("int").alias("lev"), F.concat(F.lit("L"), (F.col("o_custkey") + F.floor(k / 7)) % 4).alias("lang"), "area")


def _linked(t):
    people = _people(t)
    children = people.where("age < 18")
    return children, household.parent_summary(children, people, "id", ["dw"], "rel", "age", "lev")


@query("household_links", PEOPLE_SQL + """
select id, max(plev) max_parent, min(plev) min_parent, count(*) n_parents from k group by 1
""")
def household_links(t):
    """Highest and lowest level and number of the possible parents of each child."""
    return _linked(t)[1]


@query("linkage_rates", PEOPLE_SQL + """
select rel, count(*) n_children, count(*) filter (id in (select id from k)) n_linked,
  round(count(*) filter (id in (select id from k)) / count(*), 6) rate from ch group by 1
""")
def linkage_rates(t):
    children, linked = _linked(t)
    return household.linkage_rates(children, linked, "id", "rel")


@query("child_parent_table", PEOPLE_SQL + """
, m as (select id, any_value(lev) lev, max(plev) pl from k group by 1)
select case when grouping(lev) = 1 then 'Total' else lev::varchar end child, case when grouping(pl) = 1 then 'Total' else pl::varchar end parent, count(*) n
from m group by cube (lev, pl)
""")
def child_parent_table(t):
    """Child level by highest parent level, with margins."""
    children, linked = _linked(t)
    levels = linked.join(children.select("id", "lev"), "id").select(
        F.col("lev").cast("string").alias("child"), F.col("max_parent").cast("string").alias("parent"))
    return aggregate.cross_tab(levels, "child", "parent")


@query("transmission_rate", PEOPLE_SQL + """
, c as (select distinct id, area, plang, own from k)
select area, plang lang, count(*) n_children_with_parent, count(*) filter (own = plang) n_children_speak,
  round(count(*) filter (own = plang) / count(*), 6) transmission_rate from c group by all
""")
def transmission_rate(t):
    """Children of speaking parents, and how many of them speak the language."""
    people = _people(t)
    return household.transmission(people.where("age < 18"), people, "id", ["dw"], "rel", "age", "lang", ["area"])
