"""References and library items written out of the part table: each eight parts stand for one publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators.library import match_library
from tallystone.registry import query

LIBRARY_SQL = r"""
with u as (select p_partkey k, p_partkey // 8 u, p_size, (100000000 + (p_partkey // 8) * 97)::varchar nine from part),
c as (select *, list_sum(list_transform(range(9), lambda i: (10 - i) * substr(nine, i + 1, 1)::int)) s10,
  list_sum(list_transform(range(12), lambda i: (1 + 2 * (i % 2)) * substr('978' || nine, i + 1, 1)::int)) s13 from u),
b as (select *, nine || case (11 - s10 % 11) % 11 when 10 then 'X' else ((11 - s10 % 11) % 11)::varchar end i10, '978' || nine || ((10 - s13 % 10) % 10)::varchar i13,
  '978' || nine || ((11 - s13 % 10) % 10)::varchar bad from c),
rec as (select k, u, k % 8 m,
  case k % 8 when 0 then '10.' || (1000 + u % 90) || '/x.' || u when 5 then 'https://doi.org/10.' || (1000 + u % 90) || '/X.' || u when 1 then 'doi: 10.1/none' || k end doi,
  case k % 8 when 0 then substr(i13, 1, 3) || '-' || substr(i13, 4) when 1 then substr(i10, 1, 5) || ' ' || substr(i10, 6) when 2 then i13 when 3 then bad when 4 then case when u % 3 = 0 then bad else i10 end end isbn,
  case when k % 8 in (0, 4) then 'Señal, vol. ' || u else upper('senal vol ' || u) end title,
  case when k % 8 in (2, 7) or p_size % 5 = 0 then null when k % 8 = 6 then 'c. ' || (1900 + u % 100) || '?' else (1900 + u % 100)::varchar end "year", i13, bad from b),
keys as (select k, m, x.how, x.rank, x.key from (select k, m, unnest([
  {how: 'DOI', rank: 0, key: nullif(regexp_replace(regexp_replace(lower(coalesce(doi, '')), '^(https?://)?((dx\.)?doi\.org/|doi:\s*)', ''), '[^a-z0-9]', '', 'g'), '')},
  {how: 'ISBN', rank: 1, key: case when isbn is null then null when regexp_replace(isbn, '[^0-9]', '', 'g') = bad then '~' || bad else i13 end},
  {how: 'title + year', rank: 2, key: 'senalvol' || u || '|' || nullif(regexp_extract("year", '\d{4}'), '')},
  {how: 'title', rank: 3, key: 'senalvol' || u}]) x from rec) where x.key is not null),
lib as (select how, key, min(k) item from keys where m in (0, 4) group by all),
hit as (select k, arg_min({item: item, how: keys.how}, rank) h from keys join lib using (how, key) where m not in (0, 4) and (keys.how <> 'title' or TITLE_ALONE) group by all)
select rec.k ref, h.item item, h.how how, case when h is null then 'create_new' else 'add_to_collection' end "action" from rec left join hit using (k) where m not in (0, 4)
"""


def _with_check(nine):
    """The two forms of an ISBN, and the second with a wrong check digit."""
    digit = lambda text, i: F.substring(text, i + 1, 1).cast("int")
    s10 = sum(((10 - i) * digit(nine, i) for i in range(9)), F.lit(0))
    body = F.concat(F.lit("978"), nine)
    s13 = sum(((1 + 2 * (i % 2)) * digit(body, i) for i in range(12)), F.lit(0))
    tenth = (11 - s10 % 11) % 11
    return (F.concat(nine, F.when(tenth == 10, "X").otherwise(tenth.cast("string"))), F.concat(body, ((10 - s13 % 10) % 10).cast("string")),
            F.concat(body, ((11 - s13 % 10) % 10).cast("string")))


def _publications(t):
    k = F.col("p_partkey")
    u, m = F.floor(k / 8), k % 8
    i10, i13, bad = _with_check((100000000 + u * 97).cast("string"))
    number = F.concat(F.lit("10."), (1000 + u % 90).cast("string"))
    doi = (F.when(m == 0, F.concat(number, F.lit("/x."), u)).when(m == 5, F.concat(F.lit("https://doi.org/"), number, F.lit("/X."), u))
           .when(m == 1, F.concat(F.lit("doi: 10.1/none"), k)))
    isbn = (F.when(m == 0, F.concat(F.substring(i13, 1, 3), F.lit("-"), F.substring(i13, 4, 10)))
            .when(m == 1, F.concat(F.substring(i10, 1, 5), F.lit(" "), F.substring(i10, 6, 5))).when(m == 2, i13).when(m == 3, bad)
            .when(m == 4, F.when(u % 3 == 0, bad).otherwise(i10)))
    title = F.when(m.isin(0, 4), F.concat(F.lit("Señal, vol. "), u)).otherwise(F.upper(F.concat(F.lit("senal vol "), u)))
    year = (F.when(m.isin(2, 7) | (F.col("p_size") % 5 == 0), None).when(m == 6, F.concat(F.lit("c. "), 1900 + u % 100, F.lit("?")))
            .otherwise((1900 + u % 100).cast("string")))
    made = t.part.select(k.alias("k"), m.alias("m"), doi.alias("doi"), isbn.alias("isbn"), title.alias("title"), year.alias("year"))
    return made.where(~F.col("m").isin(0, 4)).withColumnRenamed("k", "ref"), made.where(F.col("m").isin(0, 4)).withColumnRenamed("k", "item")


def _matched(t, title_alone):
    refs, items = _publications(t)
    return match_library(refs, "ref", items, "item", title_alone).select("ref", "item", "how", "action")


@query("library_match", LIBRARY_SQL.replace("TITLE_ALONE", "false"))
def library_match(t):
    """References to library items by DOI, ISBN (two forms, faulty ones apart) and title with year."""
    return _matched(t, False)


@query("library_match_titles", LIBRARY_SQL.replace("TITLE_ALONE", "true"))
def library_match_titles(t):
    """The same with an equal title as the last resort."""
    return _matched(t, True)
