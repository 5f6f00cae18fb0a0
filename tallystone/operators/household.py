"""Links between household members through their relation to the head.

A child is linked to the adults of its dwelling whose relation code fits its
own. What is wanted of those adults is a summary, so they are summarised per
dwelling and relation first; a child then meets at most as many rows as there
are relation codes, however many people share the dwelling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators.skew import salted_join

# Relation code of a child -> relation codes of its possible parents.
PARENT_RELATIONS = {3: [1, 2], 4: [1, 2], 6: [3, 4, 5], 1: [9]}
ADULT_AGE = 18


def _wanted_relations(relation: str, rules: Mapping[int, Sequence[int]]):
    table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in rules.items()))
    return F.explode(F.try_element_at(table, F.col(relation).cast("int")))


def parent_summary(children: DataFrame, people: DataFrame, child: str, dwelling: Sequence[str], relation: str,
                   age: str, level: str, rules: Mapping[int, Sequence[int]] = PARENT_RELATIONS) -> DataFrame:
    """Number, highest and lowest level of the linked parents per child; unlinked children are absent."""
    adults = people.where(F.col(age) >= ADULT_AGE).groupBy(*dwelling, F.col(relation).cast("int").alias("_rel")).agg(
        F.count("*").alias("_n"), F.max(level).alias("_hi"), F.min(level).alias("_lo"))
    asked = children.select(child, *dwelling, _wanted_relations(relation, rules).alias("_rel"))
    linked = salted_join(asked, adults, [*dwelling, "_rel"], [child])
    return linked.groupBy(child).agg(
        F.max("_hi").alias("max_parent"), F.min("_lo").alias("min_parent"), F.sum("_n").alias("n_parents"))


def linkage_rates(children: DataFrame, linked: DataFrame, child: str, relation: str) -> DataFrame:
    """Share of children with at least one linked parent, per relation code."""
    joined = children.select(child, relation).join(linked.select(child, F.lit(1).alias("_hit")), child, "left")
    return joined.groupBy(relation).agg(F.count("*").alias("n_children"), F.count("_hit").alias("n_linked")).withColumn(
        "rate", F.round(F.col("n_linked") / F.col("n_children"), 6))


def transmission(children: DataFrame, people: DataFrame, child: str, dwelling: Sequence[str], relation: str, age: str,
                 language: str, area: Sequence[str], rules: Mapping[int, Sequence[int]] = PARENT_RELATIONS) -> DataFrame:
    """Per area and language: children with a parent who speaks it, and those who speak it too."""
    spoken = people.where((F.col(age) >= ADULT_AGE) & F.col(language).isNotNull()).select(
        *dwelling, F.col(relation).cast("int").alias("_rel"), F.col(language).alias("_lang")).distinct()
    per_place = spoken.groupBy(*dwelling, "_rel").agg(F.collect_set("_lang").alias("_langs"))  # as many as languages
    asked = children.select(child, *dwelling, *area, F.col(language).alias("_own"), _wanted_relations(relation, rules).alias("_rel"))
    linked = salted_join(asked, per_place, [*dwelling, "_rel"], [child])
    langs = linked.groupBy(child, *area, "_own").agg(F.array_distinct(F.flatten(F.collect_list("_langs"))).alias("_langs"))
    rows = langs.select(*area, "_own", F.explode("_langs").alias(language))
    return rows.groupBy(*area, language).agg(
        F.count("*").alias("n_children_with_parent"),
        F.count_if(F.coalesce(F.col("_own") == F.col(language), F.lit(False))).alias("n_children_speak"),
    ).withColumn("transmission_rate", F.round(F.col("n_children_speak") / F.col("n_children_with_parent"), 6))
