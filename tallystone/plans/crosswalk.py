"""Staged resolution of part records to part candidates on a map of nine districts, and its look-ups.

Parts whose key is no multiple of three are the records, the others the candidates. Both share a key (brand and first word of the
name). Districts are the squares of a three by three grid; some candidates lie outside all of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import resolver
from tallystone.operators.aggregate import counts_by
from tallystone.operators.skew import salted_join
from tallystone.operators.spatial import assign_points, points_in_polygons
from tallystone.registry import query
from tallystone.session import cut_lineage, shuffle_width

KEYS = ["dep", "word"]
SHOWN = 5

CROSSWALK_SQL = r"""
with p as (select p_partkey k, p_brand dep, regexp_extract(p_name, '^\w+') word, p_size, p_type, cast(substr(p_brand, 7) as int) * 7 + ascii(p_name) q from part),
r as (select k rec, dep, word, case q % 4 when 0 then q % 9 when 1 then (q + 2 * (k % 2)) % 9 else (k * 5 + p_size) % 9 end district from p where k % 3 <> 0),
g0 as (select k ident, dep, word, ((k * 31) % 997)::double / 997 * 6.4 - 0.2 x, ((k * 57) % 991)::double / 991 * 6.4 - 0.2 y,
  case p_type when 'PROMO' then 1 when 'STANDARD' then 1 when 'ECONOMY' then 2 end kind from p where k % 3 = 0),
first as (select dep, word, arg_min(x, ident) cx, arg_min(y, ident) cy from g0 group by all),
own as (select rec, cx, cy from r join first using (dep, word) where rec % 7 = 1),
g as (select g0.*, (least(greatest(floor(x / 2), 0), 2) + 3 * least(greatest(floor(y / 2), 0), 2))::bigint district,
  (select min(rec) from own where abs(x - cx) < 0.05 and abs(y - cy) < 0.05) area from g0),
pool as (select dep, word, count(*) n, min(ident) i, count(kind) kinds from g group by all),
dset as (select dep, word, district, count(*) n, min(ident) i, count(kind) kinds from g group by all),
a1 as (select r.*, coalesce(pool.n, 0) n_geo, case when pool.n = 1 then pool.i when pool.n > 1 and d.n = 1 then d.i end ident,
  case when pool.n is null then 'unmatched' when pool.n = 1 then 'unique' when d.n = 1 then 'unique_via_spatial' when d.n > 1 then 'ambiguous' else 'ambiguous_no_spatial' end st,
  case when pool.n > 1 and d.n > 1 then 'd:' || r.district else 'all' end part, case when pool.n is null or pool.n = 1 then 'name' when d.n = 1 then 'within' end stage,
  pool.kinds pk, d.kinds dk from r left join pool using (dep, word) left join dset d using (dep, word, district)),
one as (select dep, word, min(district) d from r group by all having count(distinct district) = 1),
centre as (select dep, word, arg_min(ident, (pow(x - (2 * (d % 3) + 1), 2) + pow(y - (2 * (d // 3) + 1), 2), ident)) c from g join one using (dep, word) group by all),
a2 as (select a1.* exclude (c, hit) replace (case when hit then c else ident end as ident, case when hit then 'unique_via_name' else st end as st, case when hit then 'centre' else stage end as stage)
  from (select a1.*, c, st = 'ambiguous_no_spatial' and c is not null hit from a1 left join centre using (dep, word)) a1),
shp as (select a2.rec, count(*) n, min(g.ident) i from a2 join g on g.dep = a2.dep and g.word = a2.word and g.area = a2.rec and (a2.part = 'all' or g.district = a2.district) group by all having count(*) = 1),
a3 as (select a2.rec, dep, word, district, n_geo, part, pk, dk, case when hit then i else ident end ident, case when hit then 'unique_via_usca' else st end st, case when hit then 'shape' else stage end stage
  from (select a2.*, i, stage is null and i is not null hit from a2 left join shp using (rec)) a2),
grp as (select dep, word, part, min(rec) g, count(*) k from a3 where stage is null and st = 'ambiguous' group by all having count(*) > 1),
a4 as (select a3.* exclude (g, hit) replace (case when hit then 'ambiguous_canton_split' else st end as st, case when hit then 'shared' else stage end as stage), case when hit then g end split_group
  from (select a3.*, g, stage is null and st = 'ambiguous' and g is not null hit from a3 left join grp using (dep, word, part)) a3),
a5 as (select a4.* exclude (hit) replace (case when hit then 'ambiguous_dispersed' else st end as st, case when hit then 'dispersed' else stage end as stage)
  from (select *, stage is null and (case when part = 'all' then pk else dk end) = 0 hit from a4) a4),
span as (select distinct dep, word, district from a5 where stage is null and st = 'ambiguous_no_spatial'),
two as (select dep, word, min(district) d1, max(district) d2 from span group by all having count(*) = 2 and not (abs(min(district) % 3 - max(district) % 3) <= 1 and abs(min(district) // 3 - max(district) // 3) <= 1)),
box as (select g.dep, g.word, ident, x, y, kind, area, g.district own, s.district, 'c:' || s.dep || chr(31) || s.word || chr(31) || s.district part,
  pow(greatest(2 * (s.district % 3) - x, 0, x - 2 * (s.district % 3) - 2), 2) + pow(greatest(2 * (s.district // 3) - y, 0, y - 2 * (s.district // 3) - 2), 2) d
  from g join two using (dep, word) join span s on s.dep = g.dep and s.word = g.word),
side as (select dep, word, ident, arg_min(district, (case when own = district then -1 else d end, part)) district, arg_min(part, (case when own = district then -1 else d end, part)) part,
  any_value(kind) kind from box group by all),
cset as (select dep, word, district, part, count(*) n, min(ident) i from side group by all),
a6 as (select a5.* exclude (c, hit) replace (case when hit then c.n else n_geo end as n_geo, case when hit then c.part else part end as part, case when hit and c.n = 1 then c.i else ident end as ident,
  case when hit and c.n = 1 then 'unique_via_spatial' when hit then 'ambiguous_dispersed' else st end as st, case when hit then 'split' else stage end as stage)
  from (select a5.*, stage is null and st = 'ambiguous_no_spatial' and c.n is not null hit, c from a5 left join cset c using (dep, word, district)) a5),
ka as (select dep, word, 'all' part, kind, count(*) n, min(ident) i from g where kind is not null group by all union all
  select dep, word, 'd:' || district, kind, count(*) n, min(ident) i from g where kind is not null group by all),
kb as (select dep, word, part, arg_min(n, kind) n, arg_min(i, kind) i from ka group by all having arg_min(n, kind) = 1),
x as (select rec, dep, word, district, part, split_group, case when hit then i else ident end ident, case when hit then 'unique_via_spatial' else st end match_status,
  case when hit then 'kind' else stage end stage, case when hit then 1 else n_geo end n_geo
  from (select a6.*, stage is null and kb.i is not null hit, kb.i i from a6 left join kb using (dep, word, part)) a6),
mem as (select dep, word, 'all' part, ident from g union all select dep, word, 'd:' || district, ident from g union all select dep, word, part, ident from side),
sets as (select dep, word, part, count(*) n, list_sort(list(ident))[:5] ids from mem group by all)
"""


def _crosswalk(t):
    q = F.substring("p_brand", 7, 9).cast("int") * 7 + F.ascii("p_name")
    k = F.col("p_partkey")
    # few bytes and much work: splits may outnumber row groups, and tasks without a row group have no rows; the joins after this are broadcast and keep the tasks
    dealt = t.part.repartition(shuffle_width(t.spark), k)
    parts = cut_lineage(dealt.select(k, F.col("p_brand").alias("dep"), F.regexp_extract("p_name", r"^(\w+)", 1).alias("word"), "p_size", "p_type", q.alias("q")))
    district = F.when(F.col("q") % 4 == 0, F.col("q") % 9).when(F.col("q") % 4 == 1, (F.col("q") + 2 * (k % 2)) % 9).otherwise((k * 5 + F.col("p_size")) % 9)
    records = parts.where(k % 3 != 0).select(k.alias("rec"), *KEYS, district.cast("long").alias("district"))
    kind = F.when(F.col("p_type").isin("PROMO", "STANDARD"), 1).when(F.col("p_type") == "ECONOMY", 2)
    listed = parts.where(k % 3 == 0).select(k.alias("ident"), *KEYS, (((k * 31) % 997).cast("double") / 997 * 6.4 - 0.2).alias("x"),
                                            (((k * 57) % 991).cast("double") / 991 * 6.4 - 0.2).alias("y"), kind.alias("kind"))
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    box = lambda x, y, w: F.array(F.array(corner(x, y), corner(x + w, y), corner(x + w, y + w), corner(x, y + w)))
    nine = t.part.where(k < 9).select(k.alias("district"), box((k % 3 * 2).cast("double"), (F.floor(k / 3) * 2).cast("double"), F.lit(2.0)).alias("rings"))
    first = listed.groupBy(*KEYS).agg(F.min_by("x", "ident").alias("cx"), F.min_by("y", "ident").alias("cy"))
    own = salted_join(records.where("rec % 7 = 1"), first, KEYS, ["rec"]).select(F.col("rec").alias("area"), box(F.col("cx") - 0.05, F.col("cy") - 0.05, F.lit(0.1)).alias("rings"))
    listed = cut_lineage(listed)
    placed = listed.join(assign_points(listed, "ident", "x", "y", nine, "district", "rings", 1.0).drop("how"), "ident", "left")
    placed = placed.join(points_in_polygons(listed, "ident", "x", "y", own, "area", "rings", 0.1), "ident", "left")
    named, members = resolver.name_sets(records, "rec", placed, "ident", KEYS)
    return resolver.run_stages(named, members, {
        "within": resolver.within_district("rec", "ident", KEYS), "centre": resolver.near_centre("rec", "ident", KEYS, records, nine),
        "shape": resolver.in_own_shape("rec", "ident", KEYS), "shared": resolver.shared_sets("rec", KEYS),
        "dispersed": resolver.dispersed_pools("rec", KEYS), "split": resolver.split_apart("rec", "ident", KEYS, nine, 1.0),
        "kind": resolver.best_kind("rec", "ident", KEYS)})


@query("resolver_cascade", CROSSWALK_SQL + "select rec, ident, match_status, n_geo, split_group, stage from x")
def resolver_cascade(t):
    """Records to candidates by name, then district, centroid, own polygon, shared sets, dispersed pools, split pools and kind."""
    return _crosswalk(t)[0].select("rec", "ident", "match_status", "n_geo", "split_group", "stage")


@query("status_report", CROSSWALK_SQL + "select match_status, stage, count(*) n from x group by all")
def status_report(t):
    """Records by status and by the stage that settled them."""
    return counts_by(_crosswalk(t)[0], ["match_status", "stage"])


def _some(items, n):
    """A bounded list in words, with a mark when there are more."""
    return F.concat(F.array_join(F.transform(items, lambda v: v.cast("string")), ", "), F.when(n > F.size(items), ", ...").otherwise(""))


LIST_SQL = "array_to_string({0}, ', ') || case when {1} > len({0}) then ', ...' else '' end"


@query("status_lookup", CROSSWALK_SQL + f"""
, w as (select p_partkey rec from part union all select -p_partkey - 1 from part where p_partkey % 50 = 0),
codes as (select split_group, count(*) k, list_sort(list(rec))[:5] recs from x where split_group is not null group by 1)
select w.rec, coalesce(match_status, 'not_found') match_status, case when match_status is null then 'no such code' when ident is not null then 'points to ' || ident
  when match_status = 'unmatched' then 'no candidate' when match_status = 'ambiguous_canton_split' then 'one of ' || k || ' codes (' || {LIST_SQL.format('recs', 'k')} || ') for the candidates ' || {LIST_SQL.format('ids', 'n')}
  when match_status = 'ambiguous_dispersed' then 'a pool of ' || n || ' candidates: ' || {LIST_SQL.format('ids', 'n')} else n || ' candidates to be reviewed: ' || {LIST_SQL.format('ids', 'n')} end explanation
from w left join x using (rec) left join codes using (split_group) left join sets on sets.dep = x.dep and sets.word = x.word and sets.part = x.part
""")
def status_lookup(t):
    """A batch of codes with their status in words, the first of their sibling codes and of their candidates; unknown codes are reported."""
    x, members = _crosswalk(t)
    sets = resolver.first_k(members, [*KEYS, "part"], "ident", SHOWN, "ids")
    codes = resolver.first_k(x.where("split_group is not null"), ["split_group"], "rec", SHOWN, "recs")
    wanted = t.part.select(F.col("p_partkey").alias("rec")).unionByName(t.part.where("p_partkey % 50 = 0").select((-F.col("p_partkey") - 1).alias("rec")))
    found = salted_join(salted_join(wanted.join(x, "rec", "left"), codes, ["split_group"], ["rec"], "left"), sets, [*KEYS, "part"], ["rec"], "left")
    status, ids = F.col("match_status"), _some(F.col("ids"), F.col("n_ids"))
    words = (F.when(status.isNull(), "no such code").when(F.col("ident").isNotNull(), F.concat(F.lit("points to "), "ident"))
             .when(status == resolver.UNMATCHED, "no candidate")
             .when(status == resolver.SHARED, F.concat(F.lit("one of "), "n_recs", F.lit(" codes ("), _some(F.col("recs"), F.col("n_recs")), F.lit(") for the candidates "), ids))
             .when(status == resolver.DISPERSED, F.concat(F.lit("a pool of "), "n_ids", F.lit(" candidates: "), ids))
             .otherwise(F.concat("n_ids", F.lit(" candidates to be reviewed: "), ids)))
    return found.select("rec", F.coalesce(status, F.lit(resolver.NOT_FOUND)).alias("match_status"), words.alias("explanation"))


@query("reverse_status", CROSSWALK_SQL + f"""
, w as (select p_partkey ident from part where p_partkey % 3 = 0 union all select -p_partkey - 1 from part where p_partkey % 50 = 0),
fixed as (select ident, match_status, count(*) n, list_sort(list(rec))[:5] recs, 'the one candidate of ' how from x where ident is not null group by all),
open as (select dep, word, part, match_status, count(*) n, list_sort(list(rec))[:5] recs from x where ident is null and match_status <> 'unmatched' group by all),
link as (select m.ident, match_status, sum(o.n)::bigint n, list_sort(flatten(list(recs)))[:5] recs, 'one of ' || max(s.n) || ' candidates (' || arg_max({LIST_SQL.format('s.ids', 's.n')}, (s.n, part)) || ') of ' how
  from mem m join open o using (dep, word, part) join sets s using (dep, word, part) group by all)
select w.ident, coalesce(f.match_status, 'not_found') match_status, coalesce(f.n, 0) n_records, how || {LIST_SQL.format('recs', 'f.n')} explanation
from w left join (select * from fixed union all select * from link) f using (ident)
""")
def reverse_status(t):
    """For each candidate and each status: how many records point to it or share it in a set, the first of them, and its siblings."""
    x, members = _crosswalk(t)
    place = [*KEYS, "part"]
    fixed = resolver.first_k(x.where("ident is not null"), ["ident", "match_status"], "rec", SHOWN, "recs").withColumn("how", F.lit("the one candidate of "))
    unsettled = resolver.first_k(x.where((F.col("ident").isNull()) & (F.col("match_status") != resolver.UNMATCHED)), [*place, "match_status"], "rec", SHOWN, "recs")
    sets = resolver.first_k(members, place, "ident", SHOWN, "ids")
    linked = salted_join(members.select(*place, "ident"), unsettled.join(sets, place), place, ["ident"])
    siblings = F.max(F.struct("n_ids", "part", _some(F.col("ids"), F.col("n_ids")).alias("text")))
    linked = linked.groupBy("ident", "match_status").agg(
        F.sum("n_recs").alias("n_recs"), F.slice(F.sort_array(F.flatten(F.collect_list("recs"))), 1, SHOWN).alias("recs"), siblings.alias("s"))
    linked = linked.withColumn("how", F.concat(F.lit("one of "), "s.n_ids", F.lit(" candidates ("), "s.text", F.lit(") of "))).drop("s")
    wanted = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ident")).unionByName(
        t.part.where("p_partkey % 50 = 0").select((-F.col("p_partkey") - 1).alias("ident")))
    found = wanted.join(fixed.unionByName(linked), "ident", "left")
    return found.select("ident", F.coalesce("match_status", F.lit(resolver.NOT_FOUND)).alias("match_status"),
                        F.coalesce("n_recs", F.lit(0).cast("long")).alias("n_records"), F.concat("how", _some(F.col("recs"), F.col("n_recs"))).alias("explanation"))
