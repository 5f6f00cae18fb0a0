"""References matched to the items of a library by DOI, then ISBN, then title and year."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.identifiers import doi_key, isbn_key, plain_key, year_key
from tallystone.operators.skew import salted_join

# How a match was found, in the order of precedence, and what becomes of the reference.
DOI, ISBN, TITLE_YEAR, TITLE = "DOI", "ISBN", "title + year", "title"
KNOWN, NEW = "add_to_collection", "create_new"


def publication_keys(title_alone: bool = False) -> Mapping[str, Column]:
    """Keys of a row with the columns ``doi``, ``isbn``, ``title`` and ``year``, best first."""
    title, year = plain_key(F.col("title")), year_key(F.col("year"))
    keys = {DOI: doi_key(F.col("doi")), ISBN: isbn_key(F.col("isbn")), TITLE_YEAR: F.concat(title, F.lit("|"), year)}
    return {**keys, TITLE: title} if title_alone else keys


def _keyed(df: DataFrame, ident: str, keys: Mapping[str, Column]) -> DataFrame:
    """A row per key that the record has: its rank, how it is named, and itself."""
    made = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(how).alias("how"), key.alias("key")) for i, (how, key) in enumerate(keys.items())])
    return df.select(ident, F.explode(F.filter(made, lambda k: k["key"].isNotNull())).alias("_k")).select(ident, "_k.*")


def match_library(refs: DataFrame, ref: str, library: DataFrame, item: str, title_alone: bool = False) -> DataFrame:
    """``refs`` with the ``item`` they stand for, ``how`` it was found, and the ``action`` that follows.

    All keys of a reference are looked up in one join on (how, key); the best of its hits counts, and the least
    item of those that share a key. Both tables have ``doi``, ``isbn``, ``title`` and ``year``. ``title_alone``
    accepts an equal title when no key before it does.
    """
    keys = publication_keys(title_alone)
    listed = _keyed(library, item, keys).groupBy("how", "key").agg(F.min(item).alias(item))
    hits = salted_join(_keyed(refs, ref, keys), listed, ["how", "key"], [ref])
    best = hits.groupBy(ref).agg(F.min_by(F.struct(item, "how"), "rank").alias("_best"))
    found = refs.join(best, ref, "left").withColumns({item: F.col("_best").getField(item), "how": F.col("_best.how")})
    return found.withColumn("action", F.when(F.col("how").isNull(), NEW).otherwise(KNOWN)).drop("_best")
