"""Links and table cells of stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?</a>"""


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def plain(html: Column) -> Column:
    """Text of a cell or link: no tags, no ``[n]`` footnote marks, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\[\d+\]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per link with its place in the page, target and text."""
    found = pages.select(key, F.posexplode(_all(F.col(html), LINK)).alias("pos", "_a"))
    return found.select(
        key, F.col("pos").cast("long").alias("pos"),
        F.regexp_extract("_a", r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1).alias("href"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("_a", r"(?is)<a\s[^>]*>(.*?)</a>", 1), "<[^>]*>", ""), r"\s+", " ")).alias("link_text"))


def cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per table cell with table, row and column numbers from 0."""
    tables = pages.select(key, F.posexplode(_all(F.col(html), r"(?is)<table[^>]*>(.*?)</table>", 1)).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.posexplode(_all(F.col("_t"), r"(?is)<tr[^>]*>(.*?)</tr>", 1)).alias("row_no", "_r"))
    found = rows.select(key, "table_no", "row_no", F.posexplode(_all(F.col("_r"), r"(?is)<t[hd][^>]*>(.*?)</t[hd]>", 1)).alias("col_no", "_c"))
    return found.select(key, "table_no", "row_no", "col_no", plain(F.col("_c")).alias("cell"))
