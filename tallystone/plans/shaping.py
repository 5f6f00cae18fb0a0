"""Filters, classes, decoding, parsing and scoring over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates, numbers, scoring, text
from tallystone.functions.nulls import cents
from tallystone.functions.text import pad_zeros
from tallystone.operators import joins, shape
from tallystone.operators.aggregate import counts_by
from tallystone.operators.skew import salted_join
from tallystone.registry import query
from tallystone.sources import entities, layout_text

PAIRS_SQL = ", ".join(f"({g}, {x})" for g, langs in scoring.GROUP_LANGUAGES.items() for x in langs)
GENERIC_SQL = ", ".join(map(str, scoring.GENERIC_GROUPS))


@query("mixed_geo_filter", """
with c as (select c_custkey, case when n_regionkey < 10 then '0' else '' end || n_regionkey || case when n_nationkey < 10 then '0' else '' end || n_nationkey || lpad((c_custkey % 100)::varchar, 2, '0') geo
  from customer join nation on c_nationkey = n_nationkey)
select * from c where geo like '03%' or geo like '0106%' or geo in ('020205', '000512', '021342')
""")
def mixed_geo_filter(t):
    pad = lambda c: pad_zeros(c, 2)
    geo = F.concat(pad(F.col("n_regionkey")), pad(F.col("n_nationkey")), pad(F.col("c_custkey") % 100))
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", geo.alias("geo"))
    return df.where(shape.in_areas(F.col("geo"), ["3", "0106", "020205", "000512", "021342"]))


@query("prefix_sums", """
with w as (select l_orderkey, sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'A')::double qty_a,
  sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'N')::double qty_n,
  sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'R')::double qty_r from lineitem group by 1)
select l_orderkey::varchar l_orderkey, qty_a, qty_n, qty_r, coalesce(qty_a, 0) + coalesce(qty_n, 0) + coalesce(qty_r, 0) sum_qty,
  round(qty_r / (coalesce(qty_a, 0) + coalesce(qty_n, 0) + coalesce(qty_r, 0)), 6) share_r from w
""")
def prefix_sums(t):
    """Text columns cast and rounded, then summed across a name prefix."""
    q = cents(F.col("l_quantity"))
    wide = t.lineitem.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("l_returnflag") == f, q)).cast("string").alias(f"qty_{f.lower()}") for f in "ANR"])
    numeric = shape.cast_and_round(wide, ["qty_a", "qty_n", "qty_r"])
    summed = shape.prefix_sum(numeric, "qty_", "sum_qty")
    return summed.withColumn("share_r", F.round(F.try_divide("qty_r", "sum_qty"), 6))


@query("expand_counts", """
with u as (select l_returnflag, unnest(generate_series(1, l_quantity::int)) unit from lineitem)
select l_returnflag, cast(unit as int) unit, count(*) n from u group by all
""")
def expand_counts(t):
    units = shape.expand_counts(t.lineitem.select("l_returnflag", "l_quantity"), "l_quantity")
    return counts_by(units, ["l_returnflag", "unit"])


@query("threshold_class", """
with s as (select l_suppkey, count(*) n, 100.0 * count(*) filter (l_quantity > 30) / count(*) c5,
  100.0 * count(*) filter (l_quantity > 20) / count(*) c4, 100.0 * count(*) filter (l_quantity > 10) / count(*) c2 from lineitem group by 1)
select l_suppkey, n, case when c5 >= 90 and c4 >= 90 and c2 >= 90 then 'A' when c5 > 67 and c4 > 80 and c2 > 90 then 'B'
  when c5 > 50 and c4 > 67 and c2 > 67 then 'C' when c5 > 33 and c4 > 50 and c2 > 67 then 'D' when c2 > 75 then 'E'
  when c2 > 50 then 'F' when c2 > 33 then 'G' when c2 > 10 then 'H' else 'I' end class from s
""")
def threshold_class(t):
    share = lambda k: F.count_if(F.col("l_quantity") > k) * 100.0 / F.count("*")
    s = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), share(30).alias("c5"), share(20).alias("c4"), share(10).alias("c2"))
    return s.select("l_suppkey", "n", scoring.threshold_class(F.col("c5"), F.col("c4"), F.col("c2")).alias("class"))


@query("ordinal_scale", f"""
with p(g, l) as (values {PAIRS_SQL}),
o as (select o_orderkey k, case o_orderkey % 4 when 0 then null when 1 then 2 else 1 end ident,
  nullif(o_custkey % 60, 0) g, nullif(o_orderkey % 39, 0) l1, nullif(o_custkey % 8, 7) l2,
  nullif(o_orderkey % 7, 3) l3, nullif(o_custkey % 11, 0) m from orders),
i as (select k, coalesce(ident = 1, false) q1,
  case when coalesce(ident = 1, false) then (exists (select 1 from p where p.g = o.g and p.l in (l1, l2, l3))
      or (coalesce(o.g in ({GENERIC_SQL}), false) and (coalesce(l1 between 1 and 37 and l1 <> 6, false)
        or coalesce(l2 between 1 and 37 and l2 <> 6, false) or coalesce(l3 between 1 and 37 and l3 <> 6, false))))
    else coalesce(l1 between 1 and 37 and l1 <> 6, false) or coalesce(l2 between 1 and 37 and l2 <> 6, false)
      or coalesce(l3 between 1 and 37 and l3 <> 6, false) end q2,
  coalesce(m <> 6 and m <> 999, false) q3,
  coalesce(l1 = 6, false) or coalesce(l2 = 6, false) or coalesce(l3 = 6, false) c from o)
select k as o_orderkey, q1, q2, q3, c,
  case when q1 and q2 and q3 and not c then 7.0 when q1 and q2 and q3 and c then 6.0 when q1 and q2 and not q3 then 5.0
    when q1 and not q2 and q3 then 4.5 when q1 and not q2 and not q3 then 4.0 when not q1 and q2 and q3 and not c then 3.0
    when not q1 and q2 and q3 and c then 2.0 when not q1 and q2 and not q3 then 1.0 when not q1 and not q2 and q3 then 1.5
    else 0.0 end::double "level",
  case when not q1 then 'No identity' when q2 and q3 then 'Identity + language + childhood'
    when q2 then 'Identity + language (no childhood)' when q3 then 'Identity + childhood (no current language)'
    else 'Identity only' end kind from i
""")
def ordinal_scale(t):
    """Indicators, ten-level scale and identity type from survey-style codes."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    coded = t.orders.select(
        "o_orderkey",
        F.when(key % 4 == 1, 2).when(key % 4 > 1, 1).alias("ident"),
        F.nullif(cust % 60, F.lit(0)).cast("int").alias("grp"),
        F.nullif(key % 39, F.lit(0)).cast("int").alias("l1"), F.nullif(cust % 8, F.lit(7)).cast("int").alias("l2"),
        F.nullif(key % 7, F.lit(3)).cast("int").alias("l3"), F.nullif(cust % 11, F.lit(0)).cast("int").alias("mother"))
    ind = scoring.indicators(F.col("ident"), F.col("grp"), [F.col("l1"), F.col("l2"), F.col("l3")], F.col("mother"))
    flags = coded.select("o_orderkey", *[e.alias(c) for c, e in ind.items()])
    q = [F.col(c) for c in ("q1", "q2", "q3", "c")]
    return flags.withColumns({"level": scoring.ordinal_scale(*q), "kind": scoring.identity_type(*q[:3])})


@query("whole_levels", """
select cast(floor(l_quantity / 2.0) as int) whole_level, count(*) n from lineitem group by 1
""")
def whole_levels(t):
    """Half levels folded into the level below."""
    return t.lineitem.groupBy(scoring.whole_level(F.col("l_quantity") / 2.0).alias("whole_level")).agg(
        F.count("*").alias("n"))


@query("alignment_class", """
with p as (select p_partkey, case p_type when 'ECONOMY' then 'cold' when 'STANDARD' then 'hot' else p_type end l, p_name g, p_type from part)
select p_partkey, case when g = 'small ring' then 'Named special' when contains(lower(g), lower(p_type)) or contains(lower(p_type), lower(g)) then 'Matching group'
  when g is not null then 'Different group' else 'No identity data' end specials_before,
  case when contains(lower(g), lower(l)) or contains(lower(l), lower(g)) then 'Matching group' when g = 'small ring' then 'Named special'
  when g is not null then 'Different group' else 'No identity data' end specials_after from p
""")
def alignment_class(t):
    special = {"small ring": "Named special"}
    return t.part.select(
        "p_partkey",
        scoring.alignment(F.col("p_type"), F.col("p_name"), special).alias("specials_before"),
        scoring.alignment(F.col("p_type"), F.col("p_name"), special, same={"ECONOMY": "cold", "STANDARD": "hot"},
                          specials_first=False).alias("specials_after"))


@query("three_valued_flag", """
with u as (select user_id, arg_min(event_type, (ts, event_id)) mother,
  case when user_id % 5 <> 0 then arg_max(event_type, (ts, event_id)) end l1,
  case when user_id % 3 = 1 then max(event_type) end l2, case when user_id % 7 = 2 then min(event_type) end l3 from events group by user_id)
select user_id, case when l1 is null and l2 is null and l3 is null then null
  when l1 = mother or l2 = mother or l3 = mother then true else false end is_current,
  case when l1 is null and l2 is null and l3 is null then null
  when l1 = mother or l2 = mother or l3 = mother then 'Current speaker' else 'Heritage only' end status from u
""")
def three_valued_flag(t):
    at, kind = F.struct("ts", "event_id"), "event_type"
    u = t.events.groupBy("user_id").agg(
        F.min_by(kind, at).alias("mother"), F.max_by(kind, at).alias("last"), F.max(kind).alias("hi"), F.min(kind).alias("lo"))
    uid = F.col("user_id")
    spoken = [F.when(uid % 5 != 0, F.col("last")), F.when(uid % 3 == 1, F.col("hi")), F.when(uid % 7 == 2, F.col("lo"))]
    flagged = u.select("user_id", scoring.current_speaker(spoken, F.col("mother")).alias("is_current"))
    return flagged.withColumn("status", scoring.speaker_status(F.col("is_current")))


@query("suppressed_rates", """
select l_partkey, count(*) n, case when count(*) >= 30 then round(count(*) filter (l_returnflag = 'R') / count(*), 6) end rate
from lineitem group by 1
""")
def suppressed_rates(t):
    s = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rate = F.round(F.col("r") / F.col("n"), 6)
    return s.select("l_partkey", "n", scoring.suppress_small(rate, F.col("n"), 30).alias("rate"))


@query("facility_types", """
with p as (select p_partkey, case p_size % 6 when 0 then 'DIGSA' when 1 then 'USMS CDF' when 2 then 'STATE' when 3 then 'IGSA' when 4 then 'BOP' else p_type end d from part)
select p_partkey, case when contains(d, 'IGSA') then 'Jail' when contains(d, 'STATE') then 'State Migrant Detention Center'
  when contains(d, 'BOP') then 'Federal Prison' when contains(d, 'CDF') then 'Private Migrant Detention Center' else 'Other' end published,
  case when contains(d, 'DIGSA') then 'Dedicated Migrant Detention Center' when contains(d, 'IGSA') then 'Jail'
  when contains(d, 'STATE') then 'State Migrant Detention Center' when contains(d, 'BOP') then 'Federal Prison'
  when contains(d, 'CDF') then 'Private Migrant Detention Center' else 'Other' end by_length from p
""")
def facility_types(t):
    """Ordered substring rules, in published order and with longer names first."""
    names = ["DIGSA", "USMS CDF", "STATE", "IGSA", "BOP"]
    kind = F.coalesce(*[F.when(F.col("p_size") % 6 == i, F.lit(n)) for i, n in enumerate(names)], F.col("p_type"))
    return t.part.select(
        "p_partkey", scoring.first_rule(kind, scoring.FACILITY_TYPES, "Other").alias("published"),
        scoring.first_rule(kind, scoring.FACILITY_TYPES_BY_LENGTH, "Other").alias("by_length"))


@query("era_bins", """
select o_orderkey, case when o_orderdate >= '2000-01-01' then 'third' when o_orderdate >= '1997-06-01' then 'second'
  when o_orderdate >= '1995-01-01' then 'first' end era,
  case when o_totalprice < 0 then null when o_totalprice < 100000 then 'small' when o_totalprice < 300000 then 'medium' else 'large' end size_class
from orders
""")
def era_bins(t):
    starts = [("2000-01-01", "third"), ("1997-06-01", "second"), ("1995-01-01", "first")]
    return t.orders.select(
        "o_orderkey", dates.era(F.to_date("o_orderdate"), starts).alias("era"),
        numbers.bins(F.col("o_totalprice"), [0, 100000, 300000], ["small", "medium", "large"]).alias("size_class"))


@query("mixed_date_split", """
select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate::date end serial_date,
  case when o_orderkey % 3 = 1 then 'Scheduled FY' || year(o_orderdate) when o_orderkey % 3 = 2 then strftime(o_orderdate, '%B %-d, %Y') end companion,
  case when o_orderkey % 3 = 2 then o_orderdate::date end text_date,
  'City ' || (o_custkey % 7) city, case when o_custkey % 2 = 0 then 'S' || (o_custkey % 5) || ', Land' end state from orders
""")
def mixed_date_split(t):
    """A text column holding day numbers, dates in words and remarks; a place split at its first comma."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    raw = (F.when(k % 3 == 0, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
           .when(k % 3 == 1, F.concat(F.lit("Scheduled FY"), F.year(d).cast("string")))
           .otherwise(F.date_format(d, "MMMM d, yyyy")))
    place = F.concat(F.lit("City "), (F.col("o_custkey") % 7).cast("string"), F.when(
        F.col("o_custkey") % 2 == 0, F.concat(F.lit(",  S"), (F.col("o_custkey") % 5).cast("string"), F.lit(", Land"))).otherwise(F.lit("")))
    df = t.orders.select("o_orderkey", raw.alias("raw"), place.alias("place"))
    return df.select(
        "o_orderkey", dates.serial_date(F.col("raw")).alias("serial_date"), dates.not_serial(F.col("raw")).alias("companion"),
        dates.first_date(F.col("raw"), ["MMMM d, yyyy", "d/M/yy"]).alias("text_date"),
        *text.split_first(F.col("place"), r",\s*", ["city", "state"]))


@query("header_names", """
with h as (select p_partkey, last_value(case when p_partkey % 10 = 0 then p_brand end ignore nulls) over (order by p_partkey) g, p_name from part)
select p_partkey, trim(regexp_replace(lower(g || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') var_name from h
""")
def header_names(t):
    """Names from a two-row header whose upper row is filled in only at group starts."""
    upper = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("FY24 "), F.col("p_brand"), F.lit(":")))
    df = t.part.select("p_partkey", upper.alias("h1"), F.concat(F.col("p_name"), F.lit(" FY24")).alias("h2"))
    return shape.header_names(df, "p_partkey", "h1", "h2")


@query("decode_labels", """
select event_id, case event_type when 'click' then 'Clicked' when 'view' then 'Viewed' when 'purchase' then 'Bought' else 'Code ' || event_type end type_label,
  case when floor("value")::int % 100 in (88, 98) then null else floor("value")::int % 100 end answer,
  case when floor("value")::int % 100 in (88, 98) then null when floor("value")::int % 100 = 1 then 'yes' when floor("value")::int % 100 = 2 then 'no'
  else 'Code ' || floor("value")::int % 100 end answer_label from events
""")
def decode_labels(t):
    labels = {"click": "Clicked", "view": "Viewed", "purchase": "Bought"}
    df = t.events.select("event_id", shape.decode(F.col("event_type"), labels).alias("type_label"),
                         (F.floor("value").cast("int") % 100).alias("answer"))
    return shape.zap_missing(df, {"answer": [88, 98]}, {"answer": {1: "yes", 2: "no"}})


@query("line_parse", """
select l_orderkey, l_linenumber, '0' || (l_orderkey % 9 + 1) || lpad((l_partkey % 10000)::varchar, 4, '0') code,
  case when l_linenumber = 1 then 'CAPITAL' end department, case when l_linenumber = 1 then 'Cp' else l_linenumber::varchar end section,
  case when l_linenumber = 1 then 'Town ' else 'Village ' end || l_suppkey place, l_quantity n1, round(l_discount * 100, 2) n2, round(l_tax * 100, 2) n3,
  'Group' || l_returnflag group_name, 'note ' || l_linestatus remark from lineitem
""")
def line_parse(t):
    """Lines rendered to fixed-layout text and read back into columns."""
    comma = lambda c: F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
    first = F.col("l_linenumber") == 1
    code = F.concat(F.lit("0"), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0"))
    place = F.when(first, F.concat(F.lit("CAPITAL. Cp. Town "), F.col("l_suppkey"))).otherwise(
        F.concat(F.lit("Valley "), F.col("l_linenumber"), F.lit("ª s. Village "), F.col("l_suppkey")))
    line = F.concat_ws(" ", code, place, comma(F.col("l_quantity")), comma(F.col("l_discount") * 100), comma(F.col("l_tax") * 100),
                       F.concat(F.lit("Group"), F.col("l_returnflag")), F.lit("note"), F.col("l_linestatus"))
    parsed = layout_text.parse_lines(t.spread("lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", line.alias("value")), "value", 3)
    return parsed.select("l_orderkey", "l_linenumber", "code", "department", "section", "place", "n1", "n2", "n3", "group_name", "remark")


@query("section_split", """
with r as (select c_custkey, c_mktsegment seg, case when c_custkey % 50 = 0 then c_mktsegment end h from customer),
s as (select c_custkey, h is not null hd, last_value(h ignore nulls) over (order by c_custkey) section from r)
select section, count(*) n from (
  select section from s where not hd and section is not null
  union all select k.section from s cross join (select distinct section from s where section is not null) k where hd) group by 1
""")
def section_split(t):
    """A listing with section headers split by section; header rows are shared by every section."""
    df = t.customer.withColumn("hd", F.col("c_custkey") % 50 == 0)
    marked = shape.label_sections(df, [F.col("c_custkey").asc()], F.col("hd"), F.col("c_mktsegment"), "section")
    return counts_by(shape.split_sections(marked, "section", F.col("hd")), ["section"])


@query("json_props", """
select event_id, json_extract(props, '$.k')::bigint k, coalesce(json_extract(props, '$.missing')::bigint, -1) missing,
  array_to_string(list_sort(json_keys(props)), ',') "keys" from events
""")
def json_props(t):
    props = F.from_json("props", "map<string,bigint>")
    return t.events.select(
        "event_id", F.try_element_at(props, F.lit("k")).alias("k"),
        F.coalesce(F.try_element_at(props, F.lit("missing")), F.lit(-1).cast("long")).alias("missing"),
        F.array_join(F.array_sort(F.map_keys(props)), ",").alias("keys"))


@query("map_key_frequency", """
with k as (select unnest(json_keys(props)) "key" from events) select "key", count(*) n from k group by 1
""")
def map_key_frequency(t):
    keys = t.events.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return counts_by(keys, ["key"])


@query("entity_rows", """
select 'Q' || s_suppkey qid, s_name label_en, 'Proveedor ' || s_suppkey label_es, n_name || ';' || r_name located_in,
  'en: ' || s_name || ';es: Proveedor ' || s_suppkey wikipedia_articles
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def entity_rows(t):
    """Stored entity records (JSON) to one row with labels, property values and article links."""
    name, key = F.col("s_name"), F.concat(F.lit("Proveedor "), F.col("s_suppkey"))
    text_value = lambda c: F.struct(c.alias("value"))
    title = lambda c: F.struct(c.alias("title"))
    claim = lambda c: F.struct(F.struct(F.struct(F.struct(c.alias("id")).alias("value")).alias("datavalue")).alias("mainsnak").alias("mainsnak"))
    df = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
          .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
          .select(F.concat(F.lit("Q"), F.col("s_suppkey")).alias("qid"), F.to_json(F.struct(
              F.struct(text_value(name).alias("en"), text_value(key).alias("es")).alias("labels"),
              F.struct(F.array(claim(F.col("n_name")), claim(F.col("r_name"))).alias("P131")).alias("claims"),
              F.struct(title(name).alias("enwiki"), title(key).alias("eswiki"), title(name).alias("commons")).alias("sitelinks"),
          )).alias("entity")))
    rows = entities.entity_rows(df, "qid", "entity", {"P131": "located_in"}, ["en", "es"])
    return rows.select("qid", "label_en", "label_es", F.array_join("located_in", ";").alias("located_in"),
                       F.array_join("wikipedia_articles", ";").alias("wikipedia_articles"))


@query("name_cleanup", r"""
with n as (select p_partkey, p_name || ' det. ctr (tx), nm' s from part),
i as (select p_partkey, array_to_string(list_transform(string_split(s, ' '), lambda w: case when w = '(tx),' then '(Tx),' else upper(w[1:1]) || lower(w[2:]) end), ' ') s from n)
select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\bCtr\.?\b', 'Center'), '\bDet\.?\b', 'Detention'),
  '\(Tx\)', '(Texas)'), ', Nm\b', ', New Mexico') cleaned from i
""")
def name_cleanup(t):
    raw = F.concat(F.col("p_name"), F.lit(" det. ctr (tx), nm"))
    return t.part.select("p_partkey", text.clean_facility_name(raw).alias("cleaned"))


@query("compact_numbers", """
with b as (select s_suppkey, cast(round(s_acctbal * case s_suppkey % 3 when 0 then 1 when 1 then 1000 else 1000000 end) as bigint) n from supplier)
select s_suppkey, n, case when n = 0 then '—' when n >= 1e9 then printf('%.1fB', n / 1e9) when n >= 1e6 then printf('%.1fM', n / 1e6)
  when n >= 1e3 then printf('%.0fK', n / 1e3) else n::varchar end compact, format('{:,}', n) grouped, n parsed,
  case when n < 10000 then 'pale' when n < 1000000 then 'mid' else 'gold' end shade from b
""")
def compact_numbers(t):
    factor = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    df = t.supplier.select("s_suppkey", F.round(F.col("s_acctbal") * factor).cast("long").alias("n"))
    n = F.col("n")
    return df.select("s_suppkey", "n", numbers.compact_count(n).alias("compact"), numbers.with_thousands(n).alias("grouped"),
                     numbers.strip_thousands(numbers.with_thousands(n)).alias("parsed"),
                     numbers.by_thresholds(n, [(10000, "pale"), (1000000, "mid")], "gold").alias("shade"))


@query("code_remap_join", """
with r(code, language) as (values ('eng', 'English'), ('deu', 'German'), ('fr', 'French'))
select doc_id, lang, language from documents left join r on code = case lang when 'en' then 'eng' when 'de' then 'deu' else lang end
""")
def code_remap_join(t):
    table = t.spark.createDataFrame([("eng", "English"), ("deu", "German"), ("fr", "French")], "code string, language string")
    return joins.remap_join(t.documents.select("doc_id", "lang"), "lang", {"en": "eng", "de": "deu"}, table, "code", ["doc_id"]).select(
        "doc_id", "lang", "language")


@query("composite_key_attach", """
select case when length(l_orderkey::varchar) < 10 then lpad(l_orderkey::varchar, 10, '0') else l_orderkey::varchar end || '_' || l_linenumber line_key, l_partkey, o_orderstatus, o_orderpriority
from lineitem left join orders on l_orderkey = o_orderkey
""")
def composite_key_attach(t):
    """Attributes of the household table on every person row, large households spread."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    attrs = joins.assert_unique(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority"), ["l_orderkey"])
    joined = salted_join(lines, attrs, ["l_orderkey"], ["l_linenumber", "l_partkey"], "left")
    key = F.concat_ws("_", pad_zeros(F.col("l_orderkey"), 10), F.col("l_linenumber").cast("string"))
    return joined.select(key.alias("line_key"), "l_partkey", "o_orderstatus", "o_orderpriority")


@query("semi_anti_sets", """
select 'with_orders' kind, c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)
union all select 'without_orders', c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)
union all select 'urgent_only', c_custkey from (select o_custkey c_custkey from orders where o_orderpriority = '1-URGENT'
  except select o_custkey from orders where o_orderpriority = '5-LOW')
union all select 'urgent_and_low', c_custkey from (select o_custkey c_custkey from orders where o_orderpriority = '1-URGENT'
  intersect select o_custkey from orders where o_orderpriority = '5-LOW')
""")
def semi_anti_sets(t):
    cust, orders = t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select("c_custkey")
    low = orders.where(F.col("o_orderpriority") == "5-LOW").select("c_custkey")
    kinds = {"with_orders": cust.join(orders, "c_custkey", "left_semi"),
             "without_orders": cust.join(orders, "c_custkey", "left_anti"),
             "urgent_only": urgent.subtract(low), "urgent_and_low": urgent.intersect(low)}
    out = None
    for kind, df in kinds.items():
        df = df.select(F.lit(kind).alias("kind"), "c_custkey")
        out = df if out is None else out.unionByName(df)
    return out


@query("override_union", """
select n_nationkey, case n_nationkey when 3 then 'Third Land' when 7 then 'Seventh Land' else n_name end display_name,
  n_nationkey in (select c_nationkey from customer) has_customers, coalesce(r_name, 'none') region
from nation left join region on n_regionkey = r_regionkey and r_regionkey < 4
""")
def override_union(t):
    """Direct names except where a manual row overrides them, over a fallback source."""
    manual = t.spark.createDataFrame([(3, "Third Land"), (7, "Seventh Land")], "n_nationkey int, display_name string")
    direct = t.nation.select("n_nationkey", F.col("n_name").alias("display_name"))
    named = joins.assert_unique(joins.override_union(direct, manual, "n_nationkey"), ["n_nationkey"])
    in_use = t.customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    flagged = joins.overlay(named, in_use, "n_nationkey", [], "has_customers")
    regions = t.nation.join(t.region.where("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return flagged.join(regions.select("n_nationkey", F.coalesce("r_name", F.lit("none")).alias("region")), "n_nationkey")


@query("group_all_any", """
select l_orderkey, bool_and(l_returnflag = 'R') all_returned, bool_or(l_returnflag = 'R') any_returned, count(distinct l_partkey) n_parts,
  string_agg(distinct l_returnflag, '; ' order by l_returnflag) flags,
  case when bool_or(l_returnflag = 'R') and bool_or(l_returnflag = 'N') then 'mixed' when bool_or(l_returnflag = 'R') then 'returned' else 'kept' end kind
from lineitem group by 1
""")
def group_all_any(t):
    """Group-level ALL and ANY tests, and a class from the set of types in the group."""
    r, n = F.col("l_returnflag") == "R", F.col("l_returnflag") == "N"
    g = t.lineitem.groupBy("l_orderkey").agg(
        F.bool_and(r).alias("all_returned"), F.bool_or(r).alias("any_returned"), F.bool_or(n).alias("_n"),
        F.countDistinct("l_partkey").alias("n_parts"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"))
    kind = F.when(F.col("any_returned") & F.col("_n"), "mixed").when(F.col("any_returned"), "returned").otherwise("kept")
    return g.withColumn("kind", kind).drop("_n")


@query("best_type_preference", """
with r as (select p_brand, p_size, p_partkey, case p_type when 'PROMO' then 1 when 'ECONOMY' then 2 else 3 end rk from part),
t as (select *, min(rk) over (partition by p_brand, p_size) top from r),
c as (select *, count(*) filter (rk = top) over (partition by p_brand, p_size) n_top from t)
select p_brand, p_size, p_partkey, cast(rk as int) type_rank from c where rk = top and n_top = 1
""")
def best_type_preference(t):
    """The one row of the best type per group, where that type has exactly one row."""
    rank = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "ECONOMY", 2).otherwise(3)
    per_rank = t.part.groupBy("p_brand", "p_size", rank.alias("type_rank")).agg(
        F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey"))
    best = per_rank.groupBy("p_brand", "p_size").agg(F.min_by(F.struct("type_rank", "n", "p_partkey"), "type_rank").alias("b"))
    return best.where("b.n = 1").select("p_brand", "p_size", "b.p_partkey", "b.type_rank")


@query("array_slots", """
with w as (select p_partkey, string_split(p_name, ' ') a, p_type from part),
f as (select word, count(*) n from (select unnest(a) word from w) group by 1),
s as (select unnest(range(1, (select max(len(a)) from w) + 1)) slot)
select p_partkey, p_type as kind, 'slot_' || slot slot, a[slot] word, n from w cross join s left join f on f.word = a[slot]
""")
def array_slots(t):
    """Array elements in positional columns with looked-up attributes; single-valued arrays as scalars."""
    df = t.part.select("p_partkey", F.split("p_name", " ").alias("words"), F.array("p_type").alias("kind"))
    words = counts_by(df.select(F.explode("words").alias("word")), ["word"])
    slots = shape.expand_slots(shape.simplify_arrays(df, ["kind"]), "p_partkey", "words", words, "word", ["n"])
    found = sorted(c.removesuffix("_word") for c in slots.columns if c.endswith("_word"))
    # shown as rows, so that the schema does not depend on the data
    return slots.select("p_partkey", "kind", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"{s}_word").alias("word"), F.col(f"{s}_n").alias("n"))
                                                                 for s in found])).alias("s")).select("p_partkey", "kind", "s.*")


@query("routed_slots", """
with k as (select p_partkey, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b from part)
select p_partkey, a as quality, b as thing from k
""")
def routed_slots(t):
    """Array elements routed to columns by the kind a lookup table gives them."""
    df = t.part.select("p_partkey", F.reverse(F.split("p_name", " ")).alias("words"))
    first = t.part.select(F.get(F.split("p_name", " "), F.lit(0)).alias("word"), F.lit("quality").alias("kind"))
    second = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("word"), F.lit("thing").alias("kind"))
    lookup = first.unionByName(second).distinct()
    return shape.route_slots(df, "p_partkey", "words", lookup, "word", "kind", {"quality": "quality", "thing": "thing"})
