"""Entity by period queries: presence, trajectories, fills, patches, yearly merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.nulls import cents
from tallystone.operators import joins, ordered, panel
from tallystone.registry import query

def _purchase_days(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1
    return t.events.where(F.col("event_type") == "purchase").select("user_id", day.alias("day")).distinct()


@query("presence_matrix", """
with p as (select distinct user_id, date_diff('day', date '2024-01-01', ts::date) + 1 d from events where event_type = 'purchase'),
u as (select user_id, cast(count(*) as int) n_periods from p group by 1), days as (select distinct d from p)
select u.user_id, days.d::varchar "day", p.d is not null present, n_periods from u cross join days left join p on p.user_id = u.user_id and p.d = days.d
""")
def presence_matrix(t):
    """A column for each day of the data, shown as rows so that the schema does not depend on them."""
    matrix = panel.presence_matrix(_purchase_days(t), "user_id", "day")
    return matrix.unpivot(["user_id", "n_periods"], [c for c in matrix.columns if c not in ("user_id", "n_periods")], "day", "present")


@query("presence_classes", """
with p as (select distinct user_id, event_type from events),
s as (select user_id, count(*) n, bool_or(event_type = 'purchase') b, bool_or(event_type = 'error') e from p group by 1)
select user_id, n = (select count(distinct event_type) from events) in_all, n = 1 in_one_only, not b and e errors_but_no_purchase from s
""")
def presence_classes(t):
    """Items in all sets, in one only, or in some given sets and not in others."""
    pairs = t.events.select("user_id", "event_type").distinct()
    n_sets = t.events.agg(F.countDistinct("event_type")).scalar()
    s = pairs.groupBy("user_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("b"),
        F.bool_or(F.col("event_type") == "error").alias("e"))
    return s.select("user_id", (F.col("n") == n_sets).alias("in_all"), (F.col("n") == 1).alias("in_one_only"),
                    (~F.col("b") & F.col("e")).alias("errors_but_no_purchase"))


TRAJECTORY_SQL = """
with p as (select distinct user_id, cast(date_diff('day', date '2024-01-01', ts::date) + 1 as int) d from events where event_type = 'purchase'),
b as (select min(d) lo, max(d) hi from p),
i as (select *, d - row_number() over (partition by user_id order by d) g from p),
r as (select user_id, g, min(d) f, max(d) l, count(*) n from i group by all),
s as (select user_id, min(f) first_seen, max(l) last_seen, cast(sum(n) as int) n_periods,
  cast(coalesce(max(n) filter (l = hi), 0) as int) run_current, cast(coalesce(max(n) filter (f = lo), 0) as int) run_initial,
  any_value(lo) lo, any_value(hi) hi from r, b group by 1)
"""


def _trajectories(t):
    days = _purchase_days(t)
    return panel.trajectories(days, "user_id", "day", days.agg(F.max("day")).scalar(), days.agg(F.min("day")).scalar())


@query("trajectory", TRAJECTORY_SQL + """
select user_id, first_seen, last_seen, n_periods, case when first_seen = lo and last_seen = hi and n_periods = hi - lo + 1 then 'continuous'
  when first_seen = lo and last_seen = hi then 'persistent_gaps' when first_seen = lo then 'closed'
  when last_seen = hi then 'new' else 'transient' end trajectory from s
""")
def trajectory(t):
    return _trajectories(t).select("user_id", "first_seen", "last_seen", "n_periods", "trajectory")


@query("run_lengths", TRAJECTORY_SQL + "select user_id, run_current, run_initial from s")
def run_lengths(t):
    return _trajectories(t).select("user_id", "run_current", "run_initial")


@query("latest_record", """
select user_id, max(ts) ts, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type,
  arg_max("value", (ts, event_id)) "value" from events group by 1
""")
def latest_record(t):
    df = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    return panel.first_rows(df, ["user_id"], ["ts", "event_id"], last=True)


@query("forward_fill", """
select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over w last_user_turn,
  last_value(case when role = 'user' then text end ignore nulls) over w last_user_text from conversations
window w as (partition by conv_id order by turn rows unbounded preceding)
""")
def forward_fill(t):
    """Each turn with the latest user turn up to it."""
    user = F.col("role") == "user"
    filled = ordered.forward_fill(
        t.conversations, ["conv_id"], [F.col("turn").asc()],
        {"last_user_turn": F.when(user, F.col("turn")), "last_user_text": F.when(user, F.col("text"))})
    return filled.select("conv_id", "turn", "last_user_turn", "last_user_text")


@query("running_total", """
select event_id, user_id, round(sum(cast("value" as decimal(18,2))) over (partition by user_id order by ts, event_id
  rows unbounded preceding)::double, 2) total_so_far from events
""")
def running_total(t):
    out = ordered.running_sums(t.events, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()],
                               {"total_so_far": cents(F.col("value"))})
    return out.select("event_id", "user_id", F.round(F.col("total_so_far").cast("double"), 2).alias("total_so_far"))


@query("patch_rows", """
select s_suppkey, case when s_suppkey % 10 = 3 then null when s_suppkey % 10 = 7 then upper(s_name) else s_name end s_name,
  case when s_suppkey % 10 in (3, 7) then 0.0 else s_acctbal end s_acctbal from supplier
""")
def patch_rows(t):
    base = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    last = F.col("s_suppkey") % 10
    patch = base.where(last.isin(3, 7)).select(
        "s_suppkey", F.when(last == 7, F.upper("s_name")).alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    unmatched = patch.select((-F.col("s_suppkey") - 1).alias("s_suppkey"), "s_name", "s_acctbal")
    return panel.patch_rows(base, patch.unionByName(unmatched), ["s_suppkey"])


def _slices(t):
    """The whole line table as three period tables, the first without a tax column."""
    day, middle, late = F.col("l_shipdate"), F.lit("1997-01-01").cast("date"), F.lit("2000-01-01").cast("date")
    cols = ["l_partkey", "l_quantity", "l_discount"]
    return {  # ranges of days, so that each slice reads its own row groups only
        "early": t.lineitem.where(day < middle).select(*cols),
        "middle": t.lineitem.where((day >= middle) & (day < late)).select(*cols, "l_tax"),
        "late": t.lineitem.where(day >= late).select(*cols, "l_tax"),
    }


SLICE_SQL = """
with l as (select *, case when year(l_shipdate) < 1997 then 'early' when year(l_shipdate) < 2000 then 'middle' else 'late' end p from lineitem)
"""


@query("panel_totals", SLICE_SQL + """
select p as period, count(*) n_rows, sum(cast(l_quantity as decimal(18,2)))::double qty,
  count(case when p <> 'early' then l_tax end) n_tax, case p when 'early' then 1 when 'middle' then 2 else 3 end period_rank from l group by 1
""")
def panel_totals(t):
    merged = panel.merge_years(_slices(t), "period")
    rank = F.coalesce(*[F.when(F.col("period") == p, F.lit(i)) for i, p in enumerate(("early", "middle", "late"), 1)])
    totals = merged.groupBy("period").agg(
        F.count("*").alias("n_rows"), F.sum(cents(F.col("l_quantity"))).cast("double").alias("qty"),
        F.count("l_tax").alias("n_tax"))
    return totals.withColumn("period_rank", rank).orderBy("period_rank")


@query("yearly_full_merge", SLICE_SQL + """
, q as (select l_partkey, sum(cast(l_quantity as decimal(18,2))) filter (p = 'early')::double early,
  sum(cast(l_quantity as decimal(18,2))) filter (p = 'middle')::double middle,
  sum(cast(l_quantity as decimal(18,2))) filter (p = 'late')::double late from l group by 1)
select p_partkey as l_partkey, p_brand, early, middle, late from part left join q on l_partkey = p_partkey
""")
def yearly_full_merge(t):
    """Yearly totals merged on one key, every curated part kept."""
    years = {name: df.groupBy("l_partkey").agg(F.sum(cents(F.col("l_quantity"))).cast("double").alias(name))
             for name, df in _slices(t).items()}
    merged = joins.full_merge(list(years.values()), ["l_partkey"])
    curated = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return merged.join(curated, "l_partkey", "right").select("l_partkey", "p_brand", "early", "middle", "late")


@query("era_concept_merge", SLICE_SQL + """
select p as period, p as rate_era, count(*) n, sum(cast(l_discount as decimal(18,2)))::double rate_sum from l group by 1
""")
def era_concept_merge(t):
    """A concept stored under another name in each era, as one column."""
    names = {"early": "disc_a", "middle": "disc_b", "late": "disc_c"}
    years = {k: df.withColumnRenamed("l_discount", names[k]) for k, df in _slices(t).items()}
    merged = panel.merge_eras(panel.merge_years(years, "period"), {"rate": names})
    return merged.groupBy("period", "rate_era").agg(
        F.count("rate").alias("n"), F.sum(cents(F.col("rate"))).cast("double").alias("rate_sum"))
