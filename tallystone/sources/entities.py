"""Stored entity records (JSON) to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = """
labels map<string, struct<value: string>>,
descriptions map<string, struct<value: string>>,
sitelinks map<string, struct<title: string>>,
claims map<string, array<struct<mainsnak: struct<datavalue: struct<value: struct<id: string>>>>>>
"""


def entity_rows(df: DataFrame, key: str, entity: str, properties: Mapping[str, str],
                languages: Sequence[str]) -> DataFrame:
    """Labels and descriptions per language, arrays of property values, ``lang: title`` article links."""
    e = df.select(key, F.from_json(entity, ENTITY).alias("e"))

    def said(part: str, lang: str):
        return F.try_element_at(F.col(f"e.{part}"), F.lit(lang))["value"]

    values = {name: F.filter(F.transform(F.try_element_at(F.col("e.claims"), F.lit(p)),
                                         lambda c: c["mainsnak"]["datavalue"]["value"]["id"]), lambda v: v.isNotNull())
              for p, name in properties.items()}
    wikis = F.filter(F.map_entries("e.sitelinks"), lambda s: s["key"].rlike("^[a-z_]+wiki$") & (s["key"] != "commonswiki"))
    links = F.transform(wikis, lambda s: F.concat(F.regexp_replace(s["key"], "wiki$", ""), F.lit(": "), s["value"]["title"]))
    return e.select(
        key,
        *[said("labels", x).alias(f"label_{x}") for x in languages],
        *[said("descriptions", x).alias(f"description_{x}") for x in languages],
        *[v.alias(n) for n, v in values.items()],
        F.array_sort(links).alias("wikipedia_articles"))
