"""Shares, grains, margins, transitions and class tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.nulls import cents, exact_sum
from tallystone.functions.numbers import label_compact
from tallystone.operators import aggregate as agg
from tallystone.operators import ordered, panel
from tallystone.operators.skew import salted_join
from tallystone.registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_COLUMNS = {"1-URGENT": "to_urgent", "2-HIGH": "to_high", "3-MEDIUM": "to_medium",
                    "4-NOT SPECIFIED": "to_not_specified", "5-LOW": "to_low"}


def nation_facts(t):
    """Suppliers with their nation and region names."""
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "n_name", "r_name"))


@query("geo_rollup_rates", """
with f as (
  select r_name, n_name, l_returnflag, cast(l_quantity as decimal(18,2)) q
  from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
g as (
  select r_name, n_name, cast(grouping(r_name) * 2 + grouping(n_name) as bigint) grain, count(*) n_lines,
    sum(q)::double qty, sum(case when l_returnflag = 'A' then q else 0 end)::double qty_a,
    sum(case when l_returnflag = 'N' then q else 0 end)::double qty_n,
    sum(case when l_returnflag = 'R' then q else 0 end)::double qty_r
  from f group by grouping sets ((r_name, n_name), (r_name), ()))
select *, round(qty_a * 100.0 / nullif(qty, 0), 6) qty_a_pct, round(qty_n * 100.0 / nullif(qty, 0), 6) qty_n_pct,
  round(qty_r * 100.0 / nullif(qty, 0), 6) qty_r_pct from g
""")
def geo_rollup_rates(t):
    """Quantities per nation, region and overall, with the share of each return flag."""
    flags = {"qty_a": "A", "qty_n": "N", "qty_r": "R"}
    q = cents(F.col("l_quantity"))
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n_lines"), F.sum(q).alias("qty"),
        *[F.sum(F.when(F.col("l_returnflag") == v, q).otherwise(0)).alias(c) for c, v in flags.items()])
    cells = per_supplier.join(nation_facts(t), F.col("l_suppkey") == F.col("s_suppkey"))
    out = agg.rollup(cells, ["r_name", "n_name"], [["r_name", "n_name"], ["r_name"], []],
                     {c: F.col(c) for c in ["n_lines", "qty", *flags]})
    out = out.withColumns({c: F.col(c).cast("double") for c in ["qty", *flags]})
    return agg.rates(out, list(flags), "qty")


@query("geo_summary_grains", """
with c as (
  select r_name, n_name, case when c_acctbal < 0 then 'debt' else 'credit' end side, c_mktsegment seg
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
, s as (select seg, row_number() over (order by seg) k from (select distinct seg from c)),
k as (select seg, seg k from s union all select seg, 'first two' from s where k <= 2),
g as (select r_name, n_name, side, count(*) n_total, cast(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(side) as bigint) grain
  from c group by grouping sets ((r_name, n_name, side), (r_name, n_name), (r_name, side), (r_name), (side), ())),
m as (select r_name, n_name, side, k, count(*) n, cast(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(side) as bigint) grain
  from c join k using (seg) group by grouping sets ((r_name, n_name, side, k), (r_name, n_name, k), (r_name, side, k), (r_name, k), (side, k), (k)))
select g.r_name, g.n_name, g.side, g.grain, g.n_total, n.k "class", round(100.0 * coalesce(m.n, 0) / n_total, 6) pct
from g cross join (select distinct k from k) n left join m on m.grain = g.grain and m.k = n.k and m.r_name is not distinct from g.r_name
  and m.n_name is not distinct from g.n_name and m.side is not distinct from g.side
""")
def geo_summary_grains(t):
    """Class shares per nation, region and overall, split by side and together."""
    classes = agg.categories(t.customer, "c_mktsegment")
    cells = (t.customer.groupBy("c_nationkey", F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("side"))
             .agg(F.count("*").alias("n_total"), *[F.count_if(F.col("c_mktsegment") == s).alias(f"n_{s}") for s in classes]))
    cells = (cells.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
             .withColumn("n_first two", sum((F.col(f"n_{s}") for s in classes[:2]), F.lit(0))))
    names = [*classes, "first two"]
    out = agg.rollup(
        cells, ["r_name", "n_name", "side"],
        [["r_name", "n_name", "side"], ["r_name", "n_name"], ["r_name", "side"], ["r_name"], ["side"], []],
        {"n_total": F.col("n_total"), **{f"n_{n}": F.col(f"n_{n}") for n in names}})
    # a column per class, shown as rows so that the schema does not depend on the classes
    shares = out.select("r_name", "n_name", "side", "grain", "n_total", *[F.round(F.col(f"n_{n}") * 100.0 / F.col("n_total"), 6).alias(n) for n in names])
    return shares.unpivot(["r_name", "n_name", "side", "grain", "n_total"], names, "class", "pct")


@query("share_within_group", """
with c as (select o_orderstatus, o_orderpriority, count(*) n from orders group by all)
select *, round(n / sum(n) over (partition by o_orderstatus), 6) share_in_status,
  round(n / sum(n) over (), 6) share_of_all from c
""")
def share_within_group(t):
    counts = agg.counts_by(t.orders, ["o_orderstatus", "o_orderpriority"])
    out = agg.shares(counts, "n", ["o_orderstatus"], out="share_in_status")
    out = agg.shares(out, "n", out="share_of_all")
    return out.withColumns({c: F.round(c, 6) for c in ("share_in_status", "share_of_all")})


@query("retention_by_stratum", """
with u as (select user_id, arg_min(event_type, (ts, event_id)) first_type, arg_max(event_type, (ts, event_id)) last_type
  from events group by user_id)
select first_type, count(*) total, count(*) filter (first_type = last_type) n_match,
  round_even(count(*) filter (first_type = last_type) * 100.0 / count(*), 1) pct from u group by 1
""")
def retention_by_stratum(t):
    """Share of users whose latest event type equals their first."""
    users = panel.first_and_last(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    users = users.withColumnsRenamed({"first_value": "first_type", "last_value": "last_type"})
    return agg.matched_share(users, ["first_type"], F.col("first_type") == F.col("last_type"))


@query("crosstab_margins", """
select case when grouping(o_orderstatus) = 1 then 'Total' else o_orderstatus end o_orderstatus,
  case when grouping(o_orderpriority) = 1 then 'Total' else o_orderpriority end o_orderpriority, count(*) n
from orders group by cube (o_orderstatus, o_orderpriority)
""")
def crosstab_margins(t):
    return agg.cross_tab(t.orders, "o_orderstatus", "o_orderpriority")


def _priority_moves(t):
    return panel.first_and_last(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority")


@query("transition_matrix", """
with m as (select arg_min(o_orderpriority, (o_orderdate, o_orderkey)) a, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) b
  from orders group by o_custkey),
l as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) a)
select l.a first_value, count(*) filter (b = '1-URGENT') to_urgent, count(*) filter (b = '2-HIGH') to_high,
  count(*) filter (b = '3-MEDIUM') to_medium, count(*) filter (b = '4-NOT SPECIFIED') to_not_specified,
  count(*) filter (b = '5-LOW') to_low from l left join m on l.a = m.a group by 1
""")
def transition_matrix(t):
    return agg.transition_matrix(_priority_moves(t), "first_value", "last_value", PRIORITIES, PRIORITY_COLUMNS)


@query("class_change_direction", """
with m as (select cast(left(arg_min(o_orderpriority, (o_orderdate, o_orderkey)), 1) as int) a,
    cast(left(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 1) as int) b from orders group by o_custkey)
select b - a shift, case when b < a then 'up' when b > a then 'down' else 'no change' end direction, count(*) n,
  round_even(count(*) * 100.0 / (select count(*) from m), 1) pct from m group by all
""")
def class_change_direction(t):
    """Direction and size of the class change between two readings."""
    moves = _priority_moves(t).select(
        F.substring("first_value", 1, 1).cast("int").alias("a"), F.substring("last_value", 1, 1).cast("int").alias("b"))
    counted = moves.groupBy((F.col("b") - F.col("a")).alias("shift")).agg(F.count("*").alias("n"))
    counted = counted.withColumn(
        "direction", F.when(F.col("shift") < 0, "up").when(F.col("shift") > 0, "down").otherwise("no change"))
    return agg.shares(counted, "n", out="pct", scale=100.0).withColumn("pct", F.bround("pct", 1))


@query("wide_long_roundtrip", """
select cast(year(l_shipdate) as int) ship_year, l_returnflag flag, sum(cast(l_quantity as decimal(18,2)))::double qty
from lineitem where l_returnflag in ('A', 'N', 'R') group by all
""")
def wide_long_roundtrip(t):
    """Flags spread to columns per ship year, then gathered back into rows."""
    cells = t.lineitem.groupBy(F.year("l_shipdate").alias("ship_year"), "l_returnflag").agg(
        exact_sum(F.col("l_quantity")).alias("q"))
    spread = agg.wide(cells, ["ship_year"], "l_returnflag", F.col("q"), {v: v for v in "ANR"})
    return agg.long(spread, ["ship_year"], list("ANR"), "flag", "qty").where("qty is not null")


@query("set_intersections", """
with s as (select user_id, string_agg(distinct event_type, '|' order by event_type) sets from events group by 1)
select sets, count(*) n_items from s group by 1
""")
def set_intersections(t):
    return agg.set_signatures(t.events.where("event_type is not null"), "user_id", "event_type")


@query("same_member_groups", """
with s as (select l_orderkey, list_sort(list(distinct l_partkey)) sig from lineitem group by 1),
g as (select sig, min(l_orderkey) set_id, count(*) n_groups from s group by 1 having count(*) > 1)
select l_orderkey, set_id, n_groups, len(sig) n_members from s join g using (sig)
""")
def same_member_groups(t):
    """Orders made of exactly the same parts as another order."""
    return agg.same_member_groups(t.lineitem, "l_orderkey", "l_partkey")


@query("class_quartiles", """
select c_mktsegment, count(c_acctbal) n_values, round(quantile_cont(c_acctbal, 0.25), 6) q25,
  round(quantile_cont(c_acctbal, 0.5), 6) median, round(quantile_cont(c_acctbal, 0.75), 6) q75,
  round(sum(cast(c_acctbal as decimal(18,2)))::double / count(c_acctbal), 6) mean from customer group by 1
""")
def class_quartiles(t):
    spread = ordered.quantiles(t.customer, ["c_mktsegment"], "c_acctbal", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    means = t.customer.groupBy("c_mktsegment").agg(
        (exact_sum(F.col("c_acctbal")) / F.count("c_acctbal")).alias("mean"))
    out = agg.join_totals(spread, means, ["c_mktsegment"])
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75", "mean")})


@query("top3_plus_rest", """
with s as (select n_name, s_name, cast(s_acctbal as decimal(18,2)) v, cast(s_suppkey % 7 + 1 as decimal(18,2)) w
  from supplier join nation on s_nationkey = n_nationkey),
r as (select *, row_number() over (partition by n_name order by w desc, s_name) rk from s)
select n_name, case rk when 1 then '1st' when 2 then '2nd' else '3rd' end slot, s_name as name, round(v::double, 6) "value"
from r where rk <= 3
union all select n_name, 'Rest', 'Rest', round(sum(v * w)::double / sum(w)::double, 6) from r where rk > 3 group by 1
""")
def top3_plus_rest(t):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "n_name", "s_name", "s_acctbal", (F.col("s_suppkey") % 7 + 1).alias("weight"))
    return agg.top_and_rest(df, "n_name", "s_name", "s_acctbal", "weight").withColumn("value", F.round("value", 6))


@query("weighted_distribution", """
with c as (select n_regionkey, c_mktsegment, sum(cast(abs(c_acctbal) as decimal(18,2)))::double w, count(*) n
  from customer join nation on c_nationkey = n_nationkey group by all),
s as (select *, round_even(w * 100.0 / sum(w) over (partition by n_regionkey), 1) pct,
  cast(sum(n) over (partition by n_regionkey) as bigint) n_region from c)
select n_regionkey, c_mktsegment, round(w, 2) w, pct, n_region,
  cast(round_even(n_region * pct / 100, 0) as bigint) est_count,
  n_region - cast(round_even(n_region * pct / 100, 0) as bigint) complement from s
""")
def weighted_distribution(t):
    """Weighted class shares per region, and the counts they imply."""
    cells = (t.customer.groupBy("c_nationkey", "c_mktsegment")
             .agg(F.sum(cents(F.abs("c_acctbal"))).alias("w"), F.count("*").alias("n"))
             .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("n_regionkey", "c_mktsegment")
             .agg(F.sum("w").cast("double").alias("w"), F.sum("n").alias("n")))
    sized = agg.join_totals(cells, cells.groupBy("n_regionkey").agg(F.sum("n").alias("n_region")), ["n_regionkey"])
    out = agg.shares(sized, "w", ["n_regionkey"], out="pct", scale=100.0).withColumn("pct", F.bround("pct", 1))
    est = F.bround(F.col("n_region") * F.col("pct") / 100, 0).cast("long")
    return out.select("n_regionkey", "c_mktsegment", F.round("w", 2).alias("w"), "pct", "n_region",
                      est.alias("est_count"), (F.col("n_region") - est).alias("complement"))


@query("threshold_totals", """
with c as (select n_regionkey, c_mktsegment, sum(cast(abs(c_acctbal) as decimal(18,2)))::double w, count(*) n
  from customer join nation on c_nationkey = n_nationkey group by all),
s as (select *, round_even(w * 100.0 / sum(w) over (partition by n_regionkey), 1) pct, sum(n) over (partition by n_regionkey) n_region from c),
e as (select pct, n_region::bigint n_region, cast(round_even(n_region * pct / 100, 0) as bigint) est from s),
t as (select "at", pct >= "at" reached, n_region, est from e, (select unnest([18.0, 20.0, 22.0])::double "at")),
u as (select "at", reached, 'counted' status, sum(est)::bigint n from t group by all union all select "at", reached, 'complement', sum(n_region - est)::bigint from t group by all)
select "at" threshold, reached, status, n, round_even(100.0 * n / sum(n) over (partition by "at"), 2) pct from u
""")
def threshold_totals(t):
    """Totals of the implied counts by threshold and status, in numbers and per cent of the threshold's total."""
    cells = weighted_distribution(t)
    reached = cells.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (18.0, 20.0, 22.0)]))).groupBy(
        "threshold", (F.col("pct") >= F.col("threshold")).alias("reached")).agg(
        F.sum("est_count").alias("counted"), F.sum("complement").alias("complement"))
    totals = reached.unpivot(["threshold", "reached"], ["counted", "complement"], "status", "n")
    return agg.shares(totals, "n", ["threshold"], out="pct", scale=100.0).withColumn("pct", F.bround("pct", 2))


@query("region_year_totals", """
with f as (select r_name, cast(year(l_shipdate) as int) y, sum(cast(l_quantity as decimal(18,2)))::double total
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey group by all),
c as (select *, sum(total) over (partition by y order by r_name rows unbounded preceding) cum_top from f)
select r_name, y as ship_year, total, cum_top, lag(cum_top, 1, 0) over (partition by y order by r_name) cum_base,
  (cum_top + lag(cum_top, 1, 0) over (partition by y order by r_name)) / 2 label_y from c
""")
def region_year_totals(t):
    """Year columns gathered to rows, summed by region and stacked per year."""
    per_supplier = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(
        F.sum(cents(F.col("l_quantity"))).alias("q"))
    by_nation = per_supplier.join(nation_facts(t), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "r_name", "n_name", "y").agg(F.sum("q").cast("double").alias("q"))
    wide = by_nation.groupBy("r_name", "n_name").pivot("y").agg(F.sum("q"))
    years = [c for c in wide.columns if c.isdigit()]
    rows = agg.long(wide, ["r_name", "n_name"], years, "ship_year", "q").where("q is not null")
    totals = rows.groupBy("r_name", F.col("ship_year").cast("int").alias("ship_year")).agg(F.sum("q").alias("total"))
    w = W.partitionBy("ship_year").orderBy("r_name")
    out = totals.withColumn("cum_top", F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("cum_base", F.lag("cum_top", 1, 0.0).over(w))
    return out.withColumn("label_y", (F.col("cum_top") + F.col("cum_base")) / 2)


@query("rank_shift_scale", """
with r as (select s_nationkey, s_suppkey, row_number() over w rk, count(*) over (partition by s_nationkey) k from supplier
  window w as (partition by s_nationkey order by s_acctbal, s_suppkey))
select s_nationkey, s_suppkey, rk, round(case when k > 1 then -0.6 + (rk - 1) / (k - 1) * 1.2 else 0 end, 6) shift from r
""")
def rank_shift_scale(t):
    """Rank in group rescaled to a fixed range; a single member gets 0."""
    base = t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal")
    ranked = ordered.number_rows(base, [F.col("s_acctbal").asc(), F.col("s_suppkey").asc()], "rk", ["s_nationkey"])
    sized = salted_join(ranked, agg.counts_by(base, ["s_nationkey"], out="k"), ["s_nationkey"], ["s_suppkey"])
    shift = F.when(F.col("k") > 1, -0.6 + (F.col("rk") - 1) / (F.col("k") - 1) * 1.2).otherwise(0.0)
    return sized.select("s_nationkey", "s_suppkey", "rk", F.round(shift, 6).alias("shift"))


@query("class_region_table", """
with f as (select p_type, n_regionkey k from lineitem join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
w as (select p_type, count(*) total from f group by 1),
c as (select *, cast(row_number() over (order by total desc, p_type) as int) class_rank,
  round(100.0 * total / sum(total) over (), 6) pct,
  round(100.0 * sum(total) over (order by total desc, p_type rows unbounded preceding) / sum(total) over (), 6) cum_pct from w)
, a as (select * from c union all select 'Total', sum(total)::bigint, null, 100.0, 100.0 from c),
n as (select p_type, k, count(*) n from f group by all union all select 'Total', k, count(*) from f group by 2)
select a.*, 'r' || r.k region, coalesce(n.n, 0) n from a cross join (select distinct k from f) r left join n on n.p_type = a.p_type and n.k = r.k
""")
def class_region_table(t):
    """Classes by region with total, percent, cumulative percent and a total row."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    regions = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    cells = (pairs.join(regions, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("l_partkey", "n_regionkey").agg(F.sum("n").alias("n"))
             .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))
    keys = agg.categories(regions, "n_regionkey")
    slots = [f"r{k}" for k in keys]
    table = cells.groupBy("p_type").agg(
        *[F.coalesce(F.sum(F.when(F.col("n_regionkey") == k, F.col("n"))), F.lit(0).cast("long")).alias(f"r{k}")
          for k in keys], F.sum("n").alias("total"))
    # one row per class from here on
    order = W.orderBy(F.col("total").desc(), "p_type")
    whole = table.agg(F.sum("total")).scalar()
    rows = table.select(
        "p_type", *slots, "total", F.row_number().over(order).alias("class_rank"),
        F.round(F.col("total") * 100.0 / whole, 6).alias("pct"),
        F.round(F.sum("total").over(order.rowsBetween(W.unboundedPreceding, 0)) * 100.0 / whole, 6).alias("cum_pct"))
    foot = table.agg(*[F.sum(c).alias(c) for c in [*slots, "total"]]).select(
        F.lit("Total").alias("p_type"), *slots, "total", F.lit(None).cast("int").alias("class_rank"),
        F.lit(100.0).alias("pct"), F.lit(100.0).alias("cum_pct"))
    # a column per region, shown as rows so that the schema does not depend on the regions
    return rows.unionByName(foot).unpivot(["p_type", "total", "class_rank", "pct", "cum_pct"], slots, "region", "n")


@query("lump_rare", """
with c as (select source, count(*) / (select count(*) from documents) sh from documents group by 1),
l as (select case when sh >= 0.05 then d.source when lang in ('de', 'fr', 'es') then 'Other European' else 'Other' end label
  from documents d join c using (source))
select label, count(*) n from l group by 1
""")
def lump_rare(t):
    rule = F.when(F.col("lang").isin("de", "fr", "es"), "Other European").otherwise("Other")
    return agg.counts_by(agg.lump_rare(t.documents, "source", 0.05, rule), ["label"])


@query("category_floor", """
select o_orderpriority, o_orderstatus, count(*) n from orders
where o_orderpriority in (select o_orderpriority from orders group by 1
  having count(*) > (select count(*) / 5 from orders)) group by all
""")
def category_floor(t):
    """Cells of the categories whose total passes a floor."""
    cells = agg.counts_by(t.orders, ["o_orderpriority", "o_orderstatus"])
    totals = cells.groupBy("o_orderpriority").agg(F.sum("n").alias("total"))
    floor = cells.agg(F.sum("n") / 5).scalar()
    return cells.join(totals.where(F.col("total") > floor), "o_orderpriority", "left_semi")


@query("diverging_table", """
with c as (select o_orderpriority, o_orderstatus, count(*) n from orders group by all),
k as (select o_orderstatus s, row_number() over (order by o_orderstatus) p, count(*) over () k
  from (select distinct o_orderstatus from orders)),
d as (select c.*, case when p <= floor(k / 2) then 'left' else 'right' end side,
  cast(sum(n) over (partition by o_orderpriority) as bigint) total from c join k on o_orderstatus = s),
e as (select *, case side when 'left' then -1 else 1 end sg,
  cast(sum(n) over (partition by o_orderpriority, side order by o_orderstatus rows unbounded preceding) as bigint) en from d),
f as (select o_orderpriority, o_orderstatus, n, side, total, n * sg signed, (en - n) * sg seg_start, en * sg seg_end,
  ((en - n) * sg + en * sg) / 2 seg_mid from e)
select *, case when n > 0.06 * (select max(abs(seg_mid)) from f) then 'inside'
  when n > 0.005 * (select max(abs(seg_mid)) from f) then 'above' else 'none' end placement,
  case when n >= 1000 then cast(round_even(n / 1000, 1) as varchar) || 'K' else cast(n as varchar) end "label" from f
""")
def diverging_table(t):
    counts = agg.counts_by(t.orders, ["o_orderpriority", "o_orderstatus"])
    sided = agg.diverging(counts, "o_orderpriority", "o_orderstatus")
    placed = agg.label_placement(agg.stack_positions(sided, "o_orderpriority", "o_orderstatus"))
    return placed.withColumn("label", label_compact(F.col("n")))


@query("global_rank", """
select s_suppkey, s_acctbal, row_number() over (order by coalesce(s_acctbal, 0) desc, s_suppkey) position from supplier
""")
def global_rank(t):
    """Position in the whole table, missing values counted as 0."""
    df = t.supplier.select("s_suppkey", "s_acctbal", F.coalesce("s_acctbal", F.lit(0.0)).alias("_v"))
    return ordered.number_rows(df, [F.col("_v").desc(), F.col("s_suppkey").asc()], "position").drop("_v")


@query("global_rank_topk", """
with r as (select s_suppkey, s_acctbal, row_number() over (order by coalesce(s_acctbal, 0) desc, s_suppkey) position from supplier)
select * from r where position <= 10
""")
def global_rank_topk(t):
    """The ten highest positions of the whole table."""
    df = t.supplier.select("s_suppkey", "s_acctbal", F.coalesce("s_acctbal", F.lit(0.0)).alias("_v"))
    best = df.orderBy(F.col("_v").desc(), "s_suppkey").limit(10)
    # ten rows from here on
    order = W.orderBy(F.col("_v").desc(), "s_suppkey")
    return best.withColumn("position", F.row_number().over(order).cast("long")).drop("_v")


@query("top_abs_change", """
with q as (select l_partkey, sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1998)::double a,
  sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1999)::double b from lineitem group by 1)
select l_partkey, b - a as change from q where a is not null and b is not null
order by abs(b - a) desc, l_partkey limit 20
""")
def top_abs_change(t):
    """The twenty largest changes between two years, in either direction."""
    q = cents(F.col("l_quantity"))
    day = F.col("l_shipdate")
    two = t.lineitem.where((day >= F.lit("1998-01-01").cast("date")) & (day < F.lit("2000-01-01").cast("date")))
    years = two.groupBy("l_partkey").agg(*[
        F.sum(F.when(F.year("l_shipdate") == y, q)).cast("double").alias(c) for y, c in ((1998, "a"), (1999, "b"))])
    change = years.where("a is not null and b is not null").select("l_partkey", (F.col("b") - F.col("a")).alias("change"))
    return change.orderBy(F.abs("change").desc(), "l_partkey").limit(20)


@query("two_source_shares", """
with a as (select lang, count(*) n_all from documents group by 1),
b as (select lang, count(*) n_labelled from documents where doc_id in (select doc_id from labels) group by 1)
select lang, round_even(100.0 * n_all / (select sum(n_all) from a), 2) pct_all,
  round_even(100.0 * n_labelled / (select sum(n_labelled) from b), 2) pct_labelled,
  round(100.0 * n_labelled / (select sum(n_labelled) from b) - 100.0 * n_all / (select sum(n_all) from a), 6) gap
from a full join b using (lang)
""")
def two_source_shares(t):
    """Class shares in two sources side by side, with their gap."""
    labelled = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_semi")
    a = agg.shares(agg.counts_by(t.documents, ["lang"]), "n", out="a", scale=100.0).drop("n")
    b = agg.shares(agg.counts_by(labelled, ["lang"]), "n", out="b", scale=100.0).drop("n")
    return a.join(b, "lang", "full").select(
        "lang", F.bround("a", 2).alias("pct_all"), F.bround("b", 2).alias("pct_labelled"),
        F.round(F.col("b") - F.col("a"), 6).alias("gap"))


@query("top2_label", """
with c as (select p_brand, p_type, count(*) n from part group by all),
r as (select *, row_number() over (partition by p_brand order by n desc, p_type) rk from c)
select p_brand, string_agg(p_type || ' (' || n || ')', ', ' order by rk) top_types from r where rk <= 2 group by 1
""")
def top2_label(t):
    """The two most frequent members of each group as one label."""
    top = agg.top_per_group(agg.counts_by(t.part, ["p_brand", "p_type"]), ["p_brand"],
                            [F.col("n").desc(), F.col("p_type")], 2)
    entry = F.struct("rank", F.concat("p_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    return top.groupBy("p_brand").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("top_types"))
