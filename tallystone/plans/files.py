"""Delimited files written from the tables and read back: partitioned microdata, yearly families, flattened arrays, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallystone.operators import quality, shape
from tallystone.operators.aggregate import categories
from tallystone.registry import query
from tallystone.session import scratch_path
from tallystone.sources import files


def microdata(t):
    """Orders as delimited text in folders by department; every hundredth has words where the total should be."""
    total = F.when(F.col("o_orderkey") % 100 == 7, F.lit("n. d.")).when(F.col("o_orderkey") % 10 != 3, F.format_string("%.2f", "o_totalprice"))
    people = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = people.select((F.col("n_regionkey") + 1).alias("idep"), F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("Order Status"), total.alias("Total Price"))
    path = scratch_path(t.spark, "text")
    files.write_delimited(rows, path, ["idep"])
    schema = StructType([StructField("Order Key", LongType()), StructField("Order Status", StringType()), StructField("Total Price", DoubleType())])
    return path, schema


@query("microdata_scan", """
select n_regionkey + 1 idep, o_orderkey order_key, o_orderstatus "state", case when o_orderkey % 100 <> 7 and o_orderkey % 10 <> 3 then round(o_totalprice, 2) end total_price, o_orderkey % 100 = 7 is_bad
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey + 1 in (1, 3)
""")
def microdata_scan(t):
    """Two departments of delimited microdata, lines that do not fit the schema marked, columns renamed by rule and by map."""
    path, schema = microdata(t)
    read = files.read_checked(t.spark, path, schema, partition="idep", values=[1, 3])
    named = shape.rename(shape.snake_case_names(read), {"state": "order_status"})
    return named.select("idep", "order_key", "state", F.round("total_price", 2).alias("total_price"), F.col("bad_record").isNotNull().alias("is_bad"))


@query("yearly_family", """
select o_orderkey, year(o_orderdate) fiscal_year, o_orderstatus status, case when o_orderkey % 5 <> 0 then o_custkey end custkey from orders
""")
def yearly_family(t):
    """One table from a file per year, each described by metadata: separators, column names and columns differ."""
    orders = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    family = {}
    for year in categories(orders, "year", limit=200):
        path, late, sep = scratch_path(t.spark, "text"), year % 2 == 1, "," if year % 3 else "\t"
        names = {"o_orderkey": "Key", "o_orderstatus": "Status (old)", "o_custkey": "Customer"} if late else {"o_orderkey": "key", "o_orderstatus": "status", "o_custkey": "customer"}
        own = orders.where(F.col("year") == year).drop("year").withColumnsRenamed(names)
        files.write_delimited(own, path, sep=sep)
        schema = StructType([StructField(names[c], StringType() if c == "o_orderstatus" else LongType()) for c in ("o_orderkey", "o_orderstatus", "o_custkey")])
        family[str(year)] = {"path": path, "schema": schema, "sep": sep, "names": {"o_orderkey": names["o_orderkey"], "status": names["o_orderstatus"], "custkey": names["o_custkey"]}}
    merged = files.read_years(t.spark, family)
    return merged.select("o_orderkey", F.col("fiscal_year").cast("int").alias("fiscal_year"), "status", "custkey")


@query("flattened_csv", """
select p_partkey, replace(p_name, ' ', '; ') words, case when p_size % 2 = 0 then p_brand end brand from part
""")
def flattened_csv(t):
    """A CSV file whose array column is joined text, read back."""
    path = scratch_path(t.spark, "text")
    files.write_csv(t.part.select("p_partkey", F.split("p_name", " ").alias("words"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand")), path)
    return files.read_delimited(t.spark, path, "p_partkey long, words string, brand string", sep=",", null_value="")


@query("data_dictionary", """
with v as (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) variable_name),
d as (select lower(r_name) r, case r_regionkey when 0 then 'c_custkey' when 1 then 'c_name' when 2 then 'c_acctbal' else 'c_lost_' || r_regionkey end variable_name from region)
select variable_name, case when r is not null then 'as told by ' || r end description,
  case when v.variable_name is null then 'no such variable' when d.variable_name is null then 'no description' else 'described' end state
from v full join d using (variable_name)
""")
def data_dictionary(t):
    """Variables of a table beside their descriptions, unmatched ones on either side reported."""
    k = F.col("r_regionkey")
    told = t.region.select(F.when(k == 0, "c_custkey").when(k == 1, "c_name").when(k == 2, "c_acctbal").otherwise(F.concat(F.lit("c_lost_"), k)).alias("variable_name"),
                           F.concat(F.lit("as told by "), F.lower("r_name")).alias("description"))
    return quality.data_dictionary(t.customer, told).select("variable_name", "description", "state")
