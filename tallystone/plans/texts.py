"""Fragments, reuse, provenance, counts and links in stored texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import wikitext as wt
from tallystone.functions.text import wiki_slug
from tallystone.operators import provenance, reuse
from tallystone.registry import query
from tallystone.sources import markup

FRAGMENT_SQL = r"""
f as (select {key}, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(text, '(?s)<ref.*?>.*?</ref>', '', 'g'), '<ref.*?/>', '', 'g'), '\{{\{{[^{{}}]*\}}\}}', '', 'g'),
    '(?i)\[\[(File|Image):.*?\]\]', '', 'g'), '\[\[.*?\]\]', '', 'g'), '==+.*?==+', '', 'g'), '''''+', '', 'g'), '[.!?\n\r]')) s from {table}),
g as (select distinct {key}, trim(regexp_replace(s, '\s+', ' ', 'g')) fragment from f
  where len(regexp_extract_all(trim(s), '[\p{{L}}\p{{M}}\p{{Nd}}_]+')) >= 5)
"""


@query("text_fragments", "with " + FRAGMENT_SQL.format(key="doc_id", table="documents") + "select doc_id, fragment from g")
def text_fragments(t):
    """Sentence-like pieces of at least five words, once per document."""
    return t.spread("documents", "doc_id").select("doc_id", F.explode(wt.fragments(F.col("text"))).alias("fragment"))


GRAM_SQL = r"""
d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '\p{P}', '', 'g'), '\s+'), lambda w: w <> '') ws from documents),
b as (select list_filter(regexp_split_to_array(regexp_replace(lower(text), '\p{P}', '', 'g'), '\s+'), lambda w: w <> '') ws from benchmark),
bg as (select distinct unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) g from b),
di as (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from d),
hit as (select doc_id, i - 1 p from di where array_to_string(ws[i:i + 2], ' ') in (select g from bg)),
cov as (select distinct doc_id, p + unnest([0, 1, 2]) p from hit),
isl as (select *, p - row_number() over (partition by doc_id order by p) k from cov),
sp as (select doc_id, cast(min(p) as int) span_start, cast(max(p) as int) span_end, cast(count(*) as int) n_words from isl group by doc_id, k)
"""


@query("text_reuse_spans", "with " + GRAM_SQL + "select * from sp")
def text_reuse_spans(t):
    """Runs of words in documents that are made of three-word sequences of the benchmark texts."""
    return reuse.reused_spans(t.spread("documents", "doc_id"), "doc_id", "text", t.benchmark, "text", 3)


@query("new_text_share", "with " + GRAM_SQL + """
, c as (select doc_id, sum(n_words) n from sp group by 1)
select doc_id, len(ws) n_words, cast(coalesce(n, 0) as bigint) n_reused, round(1 - coalesce(n, 0) / nullif(len(ws), 0), 6) share_new from d left join c using (doc_id)
""")
def new_text_share(t):
    spans = reuse.reused_spans(t.spread("documents", "doc_id"), "doc_id", "text", t.benchmark, "text", 3)
    return reuse.new_text_share(t.documents, "doc_id", "text", spans)


@query("sentence_first_seen", "with " + FRAGMENT_SQL.format(key="conv_id", table="conversations") + """
, a as (select conv_id, fragment sentence from g union select conv_id, fragment || ' never said' from g where length(fragment) % 3 = 0)
select conv_id, sentence, min(turn) turn, arg_min(role, turn) role from a left join conversations using (conv_id)
where false group by all
union all
select a.conv_id, a.sentence, min(c.turn), arg_min(c.role, c.turn) from a left join conversations c on c.conv_id = a.conv_id and contains(c.text, a.sentence) group by 1, 2
""")
def sentence_first_seen(t):
    """First turn of a conversation that contains each sentence; altered sentences stay unmatched."""
    turns = t.spread("conversations", "conv_id")
    said = turns.select("conv_id", F.explode(wt.fragments(F.col("text"))).alias("sentence")).distinct()
    altered = said.where(F.length("sentence") % 3 == 0).select("conv_id", F.concat("sentence", F.lit(" never said")).alias("sentence"))
    return provenance.first_seen(said.unionByName(altered), turns, "conv_id", "sentence", "text", "turn", ["role"])


@query("html_links", r"""
select page_id, l.i - 1 pos, regexp_extract(l.a, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) href,
  trim(regexp_replace(regexp_replace(regexp_extract(l.a, '(?is)<a\s[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) link_text
from (select page_id, unnest(list_zip(x, range(1, len(x) + 1))) z, z[1] a0, struct_pack(a := z[1], i := z[2]) l
  from (select page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') x from pages))
""")
def html_links(t):
    return markup.links(t.pages, "page_id", "html")


@query("html_cells", """
select c_custkey page_id, r row_no, k col_no, case when r = 0 then case k when 0 then 'Name' else 'Balance' end
  when k = 0 then c_name else c_acctbal::varchar end cell
from customer, (values (0), (1)) a(r), (values (0), (1)) b(k)
""")
def html_cells(t):
    """Cells of tables in stored pages, footnote marks removed."""
    page = F.concat(F.lit('<table class="w"><tr><th>Name</th><th>Balance[2]</th></tr>\n<tr><td><b>'), "c_name", F.lit("</b>[12]</td><td> "),
                    F.col("c_acctbal").cast("string"), F.lit(" </td></tr></table>"))
    return markup.cells(t.customer.select(F.col("c_custkey").alias("page_id"), page.alias("html")), "page_id", "html").drop("table_no")


@query("wiki_slugs", """
select page_id, length(url) n, nullif(replace(regexp_extract('https://x.org/wiki/' || replace(regexp_extract(url, '//([^/]+)', 1), '.', '_') || '#a', '/wiki/([^#?]+)', 1), '_', ' '), '') slug from pages
""")
def wiki_slugs(t):
    host = F.replace(F.regexp_extract("url", "//([^/]+)", 1), F.lit("."), F.lit("_"))
    link = F.concat(F.lit("https://x.org/wiki/"), host, F.lit("#a"))
    return t.pages.select("page_id", F.length("url").cast("long").alias("n"), wiki_slug(link).alias("slug"))


@query("pattern_counts", r"""
select page_id, len(regexp_extract_all(html, '<a[\s>]')) n_links, len(regexp_extract_all(html, '(?i)<p[\s>]')) n_paragraphs,
  len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) n_addresses from pages
""")
def pattern_counts(t):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", count(r"<a[\s>]").alias("n_links"), count(r"(?i)<p[\s>]").alias("n_paragraphs"),
                          count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").alias("n_addresses"))


@query("pattern_mentions", """
with y as (select o_custkey, cast(year(o_orderdate) as varchar) y, o_orderkey % 4 k from orders)
select o_custkey, string_agg(distinct y, ',' order by y) "years" from y where k < 3 group by 1
union all select o_custkey, '' from (select o_custkey from y group by 1 having min(k) = 3)
""")
def pattern_mentions(t):
    """Years named next to census words, sorted and unique."""
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    said = (F.when(k == 0, F.concat(F.lit("the "), y, F.lit(" national census"))).when(k == 1, F.concat(F.lit("Censo de "), y))
            .when(k == 2, F.concat(F.lit("| population_as_of = "), y)).otherwise(F.concat(F.lit("in "), y, F.lit(" nothing"))))
    texts = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_set(said), ". ").alias("text"))
    return texts.select("o_custkey", F.array_join(wt.census_years(F.col("text")), ",").alias("years"))


def _pages(t):
    """Articles written out of the part table: an infobox, citations, notes."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit("{{Infobox settlement\n| name = '"), F.lit("'"), "p_name", F.lit("''\n| type = [["), "p_brand", F.lit("|"), "p_type",
        F.lit("]]\n| size = {{convert|"), F.col("p_size").cast("string"), F.lit("|m|abbr=on}}\n| note = {{small|see {{nowrap|x}}}}\n}}\n"),
        F.lit("Text.<ref>{{Cite book |last=Stone"), k, F.lit(" |first=Ann |last2={{nowrap|Mc "), k, F.lit("}} |title=[[Link|"), "p_name",
        F.lit("]] |year=c. 19"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" |publisher=Press |pages=1–9 |isbn=978"), k,
        F.lit("}}</ref> More.<ref name=\"n\">plain note "), k, F.lit("</ref>{{efn|{{cita web|título=Web "), k,
        F.lit(" |url=http://e.org/?a=1 |fecha=2001-02-03 |autor=Pérez, Ana}}}}"))
    return t.spread("part", "p_partkey").select("p_partkey", body.alias("wikitext"))


@query("citation_table", """
select p_partkey, 'book' item_type, p_name title, 'author:Stone' || p_partkey || ':Ann;author:Mc ' || p_partkey || ':' creators,
  'c. 19' || lpad((p_partkey % 100)::varchar, 2, '0') "date", '19' || lpad((p_partkey % 100)::varchar, 2, '0') "year", 'Press' publisher, '1–9' pages, '978' || p_partkey isbn, null url, 'Stone' || p_partkey || ', Ann' first_author from part
union all select p_partkey, 'webpage', 'Web ' || p_partkey, 'author:Pérez:Ana', '2001-02-03', '2001', null, null, null, 'http://e.org/?a=1', 'Pérez, Ana' from part
union all select p_partkey, 'document', 'plain note ' || p_partkey, 'author::', null, null, null, null, null, null, null from part
""")
def citation_table(t):
    """Citation templates and bare notes of every article as typed reference rows."""
    refs = wt.reference_table(_pages(t), "p_partkey", "wikitext", localized=True)
    people = F.array_join(F.transform("creators", lambda c: F.concat_ws(":", c["creatorType"], c["lastName"], c["firstName"])), ";")
    return refs.select("p_partkey", F.col("itemType").alias("item_type"), "title", people.alias("creators"), "date", "year", "publisher",
                       "pages", F.col("ISBN").alias("isbn"), "url", "first_author")


@query("bare_refs", "select p_partkey, 'plain note ' || p_partkey note from part")
def bare_refs(t):
    return _pages(t).select("p_partkey", F.explode(wt.bare_refs(F.col("wikitext"))).alias("note"))


@query("reference_counts", "select p_partkey, 1 n_citations, 2 n_refs from part")
def reference_counts(t):
    text = F.col("wikitext")
    return _pages(t).select("p_partkey", wt.count_citations(text).alias("n_citations"), wt.count_refs(text).alias("n_refs"))


@query("infobox_map", """
select p_partkey, p_name as name, p_type as "type", p_size || ' m' as size, null as note from part
""")
def infobox_map(t):
    """Infobox parameters with markup removed, the frequent ones as columns."""
    boxes = _pages(t).select("p_partkey", wt.infobox(F.col("wikitext")).alias("box"))
    return wt.frequent_keys_to_columns(boxes, "p_partkey", "box", min_share=0.5)
