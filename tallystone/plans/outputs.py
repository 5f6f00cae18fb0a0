"""Text sinks, fingerprints and profiles over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates, numbers, text
from tallystone.operators import joins, quality
from tallystone.registry import query
from tallystone.sources import snapshots, text_sinks


@query("edit_commands", """
select s_suppkey, s_suppkey % 7 <> 0 valid, case when s_suppkey % 7 <> 0 then 'Q' || s_suppkey || ' | P1082 | ' || s_nationkey || ' | qal585 | +2024-01-01T00:00:00Z/9 | qal276 | Q'
  || s_nationkey || ' | S248 | Q12345 | S854 | "https://example.org/t" | S813 | +2026-03-09T00:00:00Z/11 | /* census */' end command from supplier
""")
def edit_commands(t):
    ident = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("X"), "s_suppkey")).otherwise(F.concat(F.lit("Q"), "s_suppkey"))
    df = t.supplier.withColumn("qid", ident)
    out = text_sinks.edit_commands(
        df, "qid", "P1082", "s_nationkey", kind="quantity", reference_item="Q12345", reference_url="https://example.org/t",
        retrieved="2026-03-09", comment="census",
        qualifiers={"P585": F.lit("+2024-01-01T00:00:00Z/9"), "P276": F.concat(F.lit("Q"), "s_nationkey")})
    return out.select("s_suppkey", "valid", "command")


@query("removal_commands", """
select s_suppkey, '-Q' || s_suppkey || ' | Les | "' || s_name || '"' command from supplier
""")
def removal_commands(t):
    df = t.supplier.withColumn("qid", F.concat(F.lit("Q"), "s_suppkey"))
    return text_sinks.edit_commands(df, "qid", "L", "s_name", kind="label", lang="es", remove=True).select("s_suppkey", "command")


@query("wikitable_rows", """
select 1 section, '|-' || chr(10) || '| ' || s_suppkey || ' || ' || s_name || '{{!}}x || ' || case when s_suppkey % 3 = 0 then '' else s_nationkey::varchar end line from supplier
union all select 0, unnest(['{| class="wikitable sortable"', '|+ Suppliers', '! key !! name !! nation']) union all select 2, '|}'
""")
def wikitable_rows(t):
    df = t.supplier.select("s_suppkey", F.concat("s_name", F.lit("|x")).alias("s_name"),
                           F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return text_sinks.wikitable_lines(df, ["s_suppkey"], "Suppliers", names=["key", "name", "nation"])


@query("ris_lines", """
with d as (select doc_id, [case when lang = 'en' then 'TY  - BOOK' else 'TY  - GEN' end, 'TI  - Document ' || doc_id, 'AU  - ' || source || ', A.',
  case when doc_id % 2 = 0 then 'ED  - Solo' end, 'PY  - 1999', 'SP  - ' || doc_id, case when doc_id % 3 = 0 then 'EP  - ' || (doc_id + 9) end, 'LA  - ' || lang, 'ER  - '] x from documents),
f as (select doc_id, list_filter(x, lambda v: v is not null) x from d)
select doc_id, unnest(x) line, cast(unnest(range(0, len(x))) as int) line_no from f
""")
def ris_lines(t):
    key = F.col("doc_id").cast("string")
    author = F.struct(F.lit("author").alias("creatorType"), F.col("source").alias("lastName"), F.lit("A.").alias("firstName"))
    editor = F.struct(F.lit("editor").alias("creatorType"), F.lit("Solo").alias("lastName"), F.lit("").alias("firstName"))
    refs = t.documents.select(
        "doc_id", F.when(F.col("lang") == "en", "book").otherwise("document").alias("itemType"), F.concat(F.lit("Document "), key).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.array(author, editor)).otherwise(F.array(author)).alias("creators"), F.lit("1999").alias("year"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(key, F.lit("–"), (F.col("doc_id") + 9).cast("string"))).otherwise(key).alias("pages"),
        F.col("lang").alias("language"))
    return text_sinks.ris_lines(refs, "doc_id")


@query("content_fingerprint", """
select cast(count(*) as bigint) n_rows, true as same_when_shuffled, false as same_when_changed from lineitem
""")
def content_fingerprint(t):
    """The fingerprint ignores row order and sees a single changed value."""
    base = snapshots.fingerprint(t.lineitem)
    shuffled = snapshots.fingerprint(t.lineitem.repartition("l_partkey", "l_orderkey"))
    one = F.when(F.struct("l_orderkey", "l_linenumber") == t.lineitem.agg(F.min(F.struct("l_orderkey", "l_linenumber"))).scalar(), -1.0)
    changed = snapshots.fingerprint(t.lineitem.withColumn("l_tax", F.coalesce(one, "l_tax")))
    key = lambda df: df.select(F.concat_ws(":", "n_rows", "hash_a", "hash_b")).scalar()
    mine = F.concat_ws(":", "n_rows", "hash_a", "hash_b")
    return base.select("n_rows", (mine == key(shuffled)).alias("same_when_shuffled"), (mine == key(changed)).alias("same_when_changed"))


@query("non_numeric_values", """
with v as (select case when event_id % 4 = 0 then event_type else "value"::varchar end v from events)
select v as "value", count(*) n from v where v is not null and try_cast(v as double) is null group by 1
""")
def non_numeric_values(t):
    mixed = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return quality.non_numeric_values(t.events.select(mixed.alias("v")), "v")


@query("column_profile", """
with p as (
  select 'documents' table_name, 'source' column_name, 'string' column_type, source v from documents union all
  select 'documents', 'lang', 'string', lang from documents union all
  select 'events', 'event_type', 'string', event_type from events),
r as (select *, dense_rank() over (partition by table_name, column_name order by v) k from p where v is not null)
select table_name, column_name, column_type, count(v) n_values, bool_or(contains(v, 'src1')) has_src1, bool_or(contains(v, 'err')) has_err,
  string_agg(distinct case when k <= 3 then v end, ' | ' order by case when k <= 3 then v end) sample_values from r group by 1, 2, 3
""")
def column_profile(t):
    return quality.profile_columns({"documents": t.documents, "events": t.events}, "^(source|lang|event_type)$", ["src1", "err"])


@query("variable_presence", """
with v as (select 'customer' t, unnest(['custkey', 'name', 'nationkey', 'acctbal', 'mktsegment']) v, unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) n from customer
  union all select 'supplier', unnest(['suppkey', 'name', 'nationkey', 'acctbal']), unnest([count(s_suppkey), count(s_name), count(s_nationkey), count(s_acctbal)]) from supplier)
select v variable_name, max(n) filter (t = 'customer') customer, max(n) filter (t = 'supplier') supplier, count(*) filter (n > 0) n_tables from v group by 1
""")
def variable_presence(t):
    short = lambda df: df.toDF(*[c.split("_", 1)[1] for c in df.columns])
    return quality.variable_presence({"customer": short(t.customer), "supplier": short(t.supplier)})


@query("duplicate_keys", """
select l_orderkey, l_linenumber, count(*) n_rows from lineitem group by all having count(*) > 1
""")
def duplicate_keys(t):
    return joins.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("latin_words", r"""
select doc_id, not regexp_matches(regexp_replace(text, '\p{Latin}', '', 'g'), '\p{L}') is_latin from documents
""")
def latin_words(t):
    """Texts all of whose letters are Latin."""
    return t.documents.select("doc_id", text.is_latin(F.col("text")).alias("is_latin"))


@query("bounded_scale", """
with r as (select min(s_acctbal) lo, max(s_acctbal) hi from supplier)
select s_suppkey, round(4 + (s_acctbal - lo) / (hi - lo) * 16, 6) radius, round(ln(1 + abs(s_acctbal)), 6) log_size from supplier, r
""")
def bounded_scale(t):
    lo, hi = (t.supplier.agg(f("s_acctbal")).scalar() for f in (F.min, F.max))
    return t.supplier.select("s_suppkey", F.round(numbers.rescale(F.col("s_acctbal"), lo, hi, 4, 20), 6).alias("radius"),
                             F.round(F.log1p(F.abs("s_acctbal")), 6).alias("log_size"))


@query("short_year_dates", """
select o_orderkey, o_orderdate::date d from orders
""")
def short_year_dates(t):
    """Dates written with two-digit years, moved to the century the data lies in."""
    written = F.date_format("o_orderdate", "d/M/yy")
    read = dates.first_date(written, ["yyyy-MM-dd", "d/M/yy"])
    late = read >= F.lit("2090-01-01").cast("date")
    return t.orders.select("o_orderkey", dates.shift_century(read, late, -1).alias("d"))
