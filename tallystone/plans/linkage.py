"""Name keys, fuzzy pairs, entities, crosswalks and cascades over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import text
from tallystone.operators import citations, joins, linkage, pairs
from tallystone.operators.aggregate import counts_by
from tallystone.operators.panel import patch_rows
from tallystone.operators.skew import salted_join
from tallystone.registry import query
from tallystone.session import cut_lineage

FOLD_SQL = "lower(strip_accents(replace(replace(replace(w, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')))"


def _words(df):
    return df.select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").distinct()


@query("equiv_key_join", f"""
with v as (select distinct unnest(regexp_split_to_array(text, '\\s+')) w from documents),
k as (select w, replace({FOLD_SQL}, '"', '') k from v where w <> '')
select w, min(w) over (partition by k) canonical, count(*) over (partition by k) n_ids from k
""")
def equiv_key_join(t):
    """Each word of the documents with the first of its spellings that differ only in case or accents."""
    words = cut_lineage(_words(t.spread("documents", "doc_id")))  # both sides start from them
    found = joins.resolve_ids(words, "w", words.withColumn("canonical", F.col("w")), "w", "canonical", text.equiv_key)
    return found.select("w", "canonical", "n_ids")


@query("match_key_join", r"""
with v as (select distinct lang = 'en' en, unnest(regexp_split_to_array(text, '\s+')) w from documents),
k as (select en, w, trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(w, 'ß', 'ss')), '[^\x20-\x7E]', '', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) k from v where w <> ''),
g as (select k, count(distinct w) n from k where en group by 1)
select w, cast(coalesce(n, 0) as bigint) n_geo, case when n is null then 'unmatched' when n = 1 then 'unique' else 'ambiguous' end match_status
from k left join g using (k) where not en
""")
def match_key_join(t):
    """Words of the other languages against the English word list on the ASCII key."""
    is_en = F.col("lang") == "en"
    listed = _words(t.spread("documents", "doc_id").where(is_en)).withColumn("k", text.match_key(F.col("w"))).withColumnRenamed("w", "ident")
    wanted = _words(t.spread("documents", "doc_id").where(~is_en)).withColumn("k", text.match_key(F.col("w")))
    return linkage.candidate_status(wanted, "w", listed, "ident", ["k"]).select("w", "n_geo", "match_status")


@query("alias_resolution", """
select c_custkey, case when c_custkey % 4 = 3 then null else n_nationkey end n_nationkey,
  case when c_custkey % 4 = 3 then 0 else 1 end n_ids, case when c_custkey % 4 = 3 then null else n_name end n_name,
  case when c_custkey % 4 = 3 then null else r_name end r_name
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def alias_resolution(t):
    """Free-text place names to ids through an alias table, then ids back to names."""
    named = t.nation.select("n_nationkey", F.array("n_name", F.concat(F.lit("N-"), "n_nationkey"), F.concat(F.lit("Land "), "n_nationkey")).alias("names"))
    aliases = joins.exploded_aliases(named, "n_nationkey", "names")
    c = t.customer.join(t.nation.select("n_nationkey", F.col("n_name").alias("nm")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    said = (F.when(k == 0, F.concat(F.lit(" "), F.lower("nm"), F.lit(" "))).when(k == 1, F.concat(F.lit('"n-'), "n_nationkey", F.lit('"')))
            .when(k == 2, F.concat(F.lit("Länd "), "n_nationkey")).otherwise(F.concat(F.lit("nowhere "), "n_nationkey")))
    inputs = c.select("c_custkey", said.alias("place"))
    found = joins.resolve_ids(inputs, "place", aliases, "alias", "n_nationkey", text.equiv_key)
    attached = salted_join(
        joins.attach_ids(inputs, found, ["place"], "n_nationkey", ["c_custkey"]), found.select("place", "n_ids"), ["place"], ["c_custkey"])
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return attached.join(names, "n_nationkey", "left").select("c_custkey", "n_nationkey", "n_ids", "n_name", "r_name")


PAIRS_SQL = """
with t as (select p_brand, p_size, p_name, min(p_partkey) id, count(*) n from part group by all),
p as (select a.p_brand, a.p_size, a.p_name text_a, b.p_name text_b, a.id id_a, b.id id_b,
  damerau_levenshtein(a.p_name, b.p_name) distance,
  1 - damerau_levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) sim
  from t a join t b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_name < b.p_name
  where damerau_levenshtein(a.p_name, b.p_name) <= floor(greatest(length(a.p_name), length(b.p_name)) * 0.2)
    and not (a.p_name = 'hot ring' and b.p_name = 'hot rod'))
"""


def _fuzzy(t):
    found = pairs.edit_similar_pairs(t.part, ["p_brand", "p_size"], "p_name", 0.8)
    excluded = t.spark.createDataFrame([("hot rod", "hot ring")], "x string, y string")
    return joins.without_pairs(found, "text_a", "text_b", excluded, "x", "y")


@query("blocked_fuzzy_pairs", PAIRS_SQL + "select p_brand, p_size, text_a, text_b, cast(distance as int) distance, round(sim, 6) similarity from p")
def blocked_fuzzy_pairs(t):
    """Part names of one brand and size that differ by few edits, minus a do-not-merge list."""
    return _fuzzy(t).withColumn("similarity", F.round("similarity", 6))


@query("jaro_pairs", """
with t as (select distinct split_part(p_name, ' ', 1) w, p_name || ' ' || p_type nm from part)
select a.w, a.nm text_a, b.nm text_b, round(1 - jaro_similarity(a.nm, b.nm), 6) distance from t a join t b on a.w = b.w and a.nm < b.nm
where jaro_similarity(a.nm, b.nm) >= 0.9 - 1e-12 and jaro_similarity(a.nm, b.nm) < 1
""")
def jaro_pairs(t):
    """Similar names among those that start with the same word."""
    named = t.part.select(F.regexp_extract("p_name", r"^(\w+)", 1).alias("w"), F.concat_ws(" ", "p_name", "p_type").alias("nm"))
    found = pairs.jaro_similar_pairs(named, ["w"], "nm", 0.1)
    return found.withColumn("distance", F.round("distance", 6))


ENTITY_SQL = PAIRS_SQL.replace("with t as", "with recursive t as") + """
, e as (select id_a u, id_b v from p union select id_b, id_a from p),
r as (select id node, id lab from t union select e.v, r.lab from r join e on e.u = r.node where r.lab < e.v),
c as (select node, min(lab) canonical_id from r group by 1),
k as (select p_partkey, canonical_id, part.p_name from part join t using (p_brand, p_size, p_name) join c on c.node = t.id),
m as (select canonical_id, arg_max(p_name, p_partkey) canonical_name, count(distinct p_name) n_variants from k group by 1)
"""


def _crosswalk(t):
    keys = t.part.groupBy("p_brand", "p_size", "p_name").agg(F.min("p_partkey").alias("id"))
    ids = keys.select("p_brand", "p_size", F.col("p_name").alias("nm"), "id")
    edges = _fuzzy(t)
    for side in "ab":
        edges = edges.join(ids.withColumnsRenamed({"nm": f"text_{side}", "id": f"id_{side}"}), ["p_brand", "p_size", f"text_{side}"])
    clusters = linkage.entity_map(keys, "id", edges, "id_a", "id_b")
    clusters = cut_lineage(keys.join(clusters, "id"))
    return salted_join(t.part, clusters, ["p_brand", "p_size", "p_name"], ["p_partkey"]).select("p_partkey", "p_name", "canonical_id")


@query("entity_clusters", ENTITY_SQL + """
select p_partkey, canonical_id, case when canonical_id % 100 = 7 then upper(canonical_name) else canonical_name end canonical_name, n_variants
from k join m using (canonical_id)
""")
def entity_clusters(t):
    """Every part with its cluster, the cluster's latest name (some overridden) and its variants."""
    keyed = _crosswalk(t)
    names = linkage.canonical_names(keyed, "canonical_id", ["p_partkey"], {"p_name": "canonical_name"})
    manual = names.where("canonical_id % 100 = 7").select("canonical_id", F.upper("canonical_name").alias("canonical_name"))
    names = patch_rows(names, manual, ["canonical_id"])
    sizes = keyed.groupBy("canonical_id").agg(F.countDistinct("p_name").alias("n_variants"))
    return salted_join(keyed.select("p_partkey", "canonical_id"), names.join(sizes, "canonical_id"), ["canonical_id"], ["p_partkey"])


@query("location_variants", """
with n as (select distinct p_brand, p_size, p_name from part)
select p_brand, p_size, p_name, n_names from n join (select p_brand, p_size, count(*) n_names from n group by all having count(*) > 1) using (p_brand, p_size)
""")
def location_variants(t):
    return linkage.name_variants(t.part, ["p_brand", "p_size"], "p_name")


def _in_year(year):
    """Ship dates of a year, as a range that reaches the scan."""
    day = F.col("l_shipdate")
    return (day >= F.lit(f"{year}-01-01").cast("date")) & (day < F.lit(f"{year + 1}-01-01").cast("date"))


def _shipped(t, year):
    lines = t.lineitem.where(_in_year(year)).select(F.col("l_partkey").alias("p_partkey")).distinct()
    return lines.join(t.part.select("p_partkey", "p_brand", "p_name"), "p_partkey")


SHIPPED_SQL = """
with a as (select distinct p_brand, p_name from lineitem join part on l_partkey = p_partkey where year(l_shipdate) = 1995),
b as (select distinct p_brand, p_name from lineitem join part on l_partkey = p_partkey where year(l_shipdate) = 2001)
"""


@query("source_compare", SHIPPED_SQL + """
, n as (select p_brand, p_name, bool_or(s = 1) in_old, bool_or(s = 2) in_new from (select *, 1 s from a union all select *, 2 from b) group by all),
q as (select p_brand, bool_or(in_old) and bool_or(in_new) place_in_both, count(*) n_names from n group by 1)
select * from n join q using (p_brand)
""")
def source_compare(t):
    return linkage.compare_sources(_shipped(t, 1995), _shipped(t, 2001), ["p_brand"], "p_name", ("old", "new"))


@query("reconcile_sets", """
with a as (select distinct l_partkey k from lineitem where year(l_shipdate) = 1995), b as (select distinct l_partkey k from lineitem where year(l_shipdate) = 2001)
select case when a.k is not null and b.k is not null then 'both' when b.k is null then 'old_only' else 'new_only' end side, count(*) n
from a full join b on a.k = b.k group by 1
""")
def reconcile_sets(t):
    year = lambda y: t.lineitem.where(_in_year(y)).select("l_partkey")
    return counts_by(joins.reconcile(year(1995), year(2001), ["l_partkey"], ("old", "new")), ["side"])


def _first_sentence(c):
    return F.nullif(F.trim(F.regexp_extract(c, r"^([^.!?\n]+)", 1)), F.lit(""))


@query("match_cascade", r"""
with b as (select *, regexp_extract(text, '^([^.!?\n]+)', 1) s from benchmark), d as (select *, regexp_extract(text, '^([^.!?\n]+)', 1) s from documents),
e as (select text k, min(item_id) v from b group by 1), f as (select lower(regexp_replace(text, '\s', '', 'g')) k, min(item_id) v from b group by 1),
g as (select trim(s) k, min(item_id) v from b where trim(s) <> '' group by 1)
select doc_id, coalesce(e.v, f.v, g.v) item_id, case when e.v is not null then 'exact' when f.v is not null then 'spacing' when g.v is not null then 'first sentence' end match_rule
from d left join e on e.k = d.text left join f on f.k = lower(regexp_replace(d.text, '\s', '', 'g')) left join g on g.k = nullif(trim(d.s), '')
""")
def match_cascade(t):
    """Documents to reference items: same text, same but for spacing, same first sentence."""
    def keyed(df, ident):
        return df.select(ident, F.sha2("text", 256).alias("k_exact"), F.sha2(text.title_match_key(F.col("text")), 256).alias("k_space"),
                         F.sha2(_first_sentence(F.col("text")), 256).alias("k_first"))
    items, docs = keyed(t.benchmark, "item_id"), keyed(t.spread("documents", "doc_id"), "doc_id")
    rules = {"exact": (F.col("k_exact"), items, "k_exact", "item_id"), "spacing": (F.col("k_space"), items, "k_space", "item_id"),
             "first sentence": (F.col("k_first"), items, "k_first", "item_id")}
    return linkage.cascade(docs, "doc_id", rules, "item_id").select("doc_id", "item_id", "match_rule")


ROUNDS_SQL = """
with d as (select s_suppkey, case when s_suppkey % 4 = 0 then n_name when s_suppkey % 4 = 1 then 'Greater ' || n_name when s_suppkey % 4 = 2 then 'X' || s_suppkey else 'Manual' || n_nationkey end label, n_nationkey, n_regionkey
  from supplier join nation on s_nationkey = n_nationkey)
"""


def _match_in_rounds(t, dropped=None):
    k = F.col("s_suppkey") % 4
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", (
        F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("Greater "), "n_name"))
        .when(k == 2, F.concat(F.lit("X"), "s_suppkey")).otherwise(F.concat(F.lit("Manual"), "n_nationkey"))).alias("label"))
    names = t.nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("label"))
    manual = t.nation.select("n_nationkey", F.concat(F.lit("Manual"), "n_nationkey").alias("label"))
    short = F.regexp_replace("label", "^(Greater|Lower) ", "")
    return linkage.rounds(d, "s_suppkey", {
        "exact": lambda r: r.join(names, ["label", "n_regionkey"]),
        "stripped": lambda r: r.withColumn("label", short).join(names, ["label", "n_regionkey"]),
        "manual": lambda r: r.join(manual, "label")}, "n_nationkey", dropped)


@query("matching_rounds", ROUNDS_SQL + """
select s_suppkey, case when s_suppkey % 4 = 2 then null else n_nationkey end n_nationkey,
  case s_suppkey % 4 when 0 then 'exact' when 1 then 'stripped' when 3 then 'manual' end round from d
""")
def matching_rounds(t):
    """Labels matched in rounds on what is left: exact, affix stripped, then a manual list."""
    return _match_in_rounds(t).select("s_suppkey", "n_nationkey", "round")


@query("matching_coverage", ROUNDS_SQL + """
, m as (select case s_suppkey % 4 when 0 then 'exact' when 1 then 'stripped' when 3 then 'manual' end round from d where s_suppkey % 10 <> 7)
select round, count(*) n, round_even(100 * count(*) / (select count(*) from m), 2) pct from m group by 1
""")
def matching_coverage(t):
    """What each round matched, after a drop-list."""
    dropped = t.supplier.where(F.col("s_suppkey") % 10 == 7).select("s_suppkey")
    return linkage.coverage(_match_in_rounds(t, dropped))


@query("region_fallback", """
select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then r_name end, case when s_suppkey % 3 = 1 then r_name end, case when s_nationkey = 5 then 'FIXED' end) region,
  case when s_suppkey % 3 = 0 then 'direct' when s_suppkey % 3 = 1 then 'parent' when s_nationkey = 5 then 'manual' end region_rule
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def region_fallback(t):
    """Region of an entity: its own, else its parent's, else a manual constant."""
    k = F.col("s_suppkey") % 3
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", F.when(k == 0, F.col("n_regionkey")).alias("own"), F.when(k == 1, F.col("s_nationkey")).alias("parent"))
    direct = t.region.select(F.col("r_regionkey").alias("own"), F.col("r_name").alias("r_direct"))
    through = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("parent"), F.col("r_name").alias("r_parent"))
    joined = s.join(direct, "own", "left").join(through, "parent", "left")
    manual = F.when(F.col("s_nationkey") == 5, "FIXED")
    return joined.withColumns(joins.first_of(
        {"direct": F.col("r_direct"), "parent": F.col("r_parent"), "manual": manual}, "region", "region_rule")).select(
        "s_suppkey", "region", "region_rule")


@query("dedup_with_counts", """
with d as (select doc_id, lang, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(regexp_replace(replace(lower(text), '&nbsp;', ' '), '&#[0-9]+;', ' ', 'g'),
  'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) k from documents)
select min(doc_id) doc_id, lang, count(*) n_citations from d group by lang, k
""")
def dedup_with_counts(t):
    """First document of each set of copies under the normalised key, with the number of copies."""
    key = F.sha2(text.citation_key(F.col("text"), F.lit(None).cast("string"), F.col("lang")), 256)
    return t.spread("documents", "doc_id").select(key.alias("k"), "doc_id", "lang").groupBy("k").agg(
        F.min_by("lang", "doc_id").alias("lang"), F.count("*").alias("n_citations"), F.min("doc_id").alias("doc_id")).drop("k")


@query("metadata_overlay", """
select d.doc_id, case when l.doc_id is not null and l.quality = 1 then 'curated ' || d.lang else d.source end source,
  case when l.doc_id is null then 'skipped' when l.quality = 1 then 'enriched' else 'failed' end enrich_status
from documents d left join (select distinct * from labels) l using (doc_id)
""")
def metadata_overlay(t):
    """Enriched values win where they are not blank; the status says what happened."""
    extra = t.labels.distinct().join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.concat(F.lit("curated "), "lang")).otherwise(" ").alias("source"))
    out = citations.overlay_metadata(t.documents.select("doc_id", "source"), "doc_id", {"enriched": F.col("doc_id")}, extra, "key", ["source"])
    return out.select("doc_id", "source", "enrich_status")


@query("missing_titles", """
with a as (select distinct p_name || ' ' || p_type title, p_brand target from part where p_size <= 40),
e as (select distinct p_name || ' ' || p_type title from part where p_size > 40)
select title, target, 'https://example.org/wiki/' || replace(title, ' ', '+') url, '#REDIRECT [[' || target || ']]' body from a where title not in (select title from e)
""")
def missing_titles(t):
    """Redirect rows for alias titles that do not exist yet."""
    title = F.concat_ws(" ", "p_name", "p_type").alias("title")
    aliases = t.part.where("p_size <= 40").select(title, F.col("p_brand").alias("target")).distinct()
    return citations.redirects(aliases, t.part.where("p_size > 40").select(title), "https://example.org/wiki/")


@query("title_match", r"""
with a as (select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then replace(p_name, ' ', '   ') else p_name || '!' end t from part),
e as (select lower(regexp_replace(p_name, '\s', '', 'g')) k, min(p_name) title from part group by 1)
select p_partkey, title from a left join e on k = lower(regexp_replace(t, '\s', '', 'g'))
""")
def title_match(t):
    """Exact titles but for case and spaces."""
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("   "))).otherwise(F.concat("p_name", F.lit("!")))
    titles = t.part.groupBy(text.title_match_key(F.col("p_name")).alias("k")).agg(F.min("p_name").alias("title"))
    return salted_join(t.part.select("p_partkey", text.title_match_key(said).alias("k")), titles, ["k"], ["p_partkey"], "left").select("p_partkey", "title")
