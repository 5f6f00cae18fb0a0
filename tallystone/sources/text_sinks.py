"""Text forms of tables: wiki tables, RIS records, edit commands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RIS type by item type.
RIS_TYPES = {
    "book": "BOOK", "bookSection": "CHAP", "journalArticle": "JOUR", "webpage": "ELEC", "newspaperArticle": "NEWS",
    "encyclopediaArticle": "ENCYC", "magazineArticle": "MGZN", "thesis": "THES", "conferencePaper": "CONF", "report": "RPRT",
    "videoRecording": "VIDEO", "document": "GEN",
}
CREATOR_TAGS = {"editor": "ED", "translator": "A3"}


def wikitable_lines(df: DataFrame, order: Sequence[str], caption: str | None = None, css: str = "wikitable sortable",
                    names: Sequence[str] | None = None) -> DataFrame:
    """Lines of a wiki table, numbered by the given order columns for a sorted write.

    Header and footer lines sort before and after all rows through ``section``.
    """
    spark = df.sparkSession
    names = list(names or df.columns)
    head = [f'{{| class="{css}"'] + ([f"|+ {caption}"] if caption else []) + ["! " + " !! ".join(names)]
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("{{!}}")), F.lit("")) for c in df.columns]
    body = df.select(F.lit(1).alias("section"), F.struct(*[F.col(c).cast("string").alias(c) for c in order]).alias("_k"),
                     F.concat(F.lit("|-\n| "), F.concat_ws(" || ", *cells)).alias("line"), *[F.col(c).alias(f"_o_{c}") for c in order])
    fixed = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, 0, "|}")], "section int, _i int, line string")
    rows = body.drop("_k").withColumn("_i", F.lit(0)).unionByName(fixed, allowMissingColumns=True)
    return rows.orderBy("section", "_i", *[f"_o_{c}" for c in order]).select("section", "line")


def ris_lines(refs: DataFrame, key: str) -> DataFrame:
    """RIS lines per reference: one row per line with its place, closed by ``ER``."""
    def tag(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}  - "), value))

    def col(name: str) -> Column:
        return F.col(name) if name in refs.columns else F.lit(None).cast("string")

    kind = F.coalesce(*[F.when(col("itemType") == k, F.lit(v)) for k, v in RIS_TYPES.items()], F.lit("GEN"))

    def person(c: Column) -> Column:
        name = F.when(c["firstName"] != "", F.concat(c["lastName"], F.lit(", "), c["firstName"])).otherwise(c["lastName"])
        label = F.coalesce(*[F.when(c["creatorType"] == k, F.lit(v)) for k, v in CREATOR_TAGS.items()], F.lit("AU"))
        return F.when(F.coalesce(name, F.lit("")) != "", F.concat(label, F.lit("  - "), name))

    people = F.transform(col("creators"), person) if "creators" in refs.columns else F.array().cast("array<string>")
    pages = F.split(col("pages"), "[–—-]", 2)
    section = col("itemType") == "bookSection"
    lines = F.concat(
        F.array(tag("TY", kind), tag("TI", col("title"))), people,
        F.array(
            tag("PY", col("year")), tag("DA", col("date")), tag("PB", col("publisher")), tag("CY", col("place")),
            tag("JO", col("publicationTitle")), tag("T2", col("publicationTitle")), tag("VL", col("volume")), tag("IS", col("issue")),
            tag("SP", F.trim(F.get(pages, F.lit(0)))), tag("EP", F.trim(F.get(pages, F.lit(1)))), tag("SN", col("ISBN")), tag("SN", col("ISSN")),
            tag("DO", col("DOI")), tag("UR", col("url")), tag("LA", col("language")), tag("ET", col("edition")), tag("T3", col("series")),
            tag("Y2", col("accessDate")), F.when(section, tag("BT", col("bookTitle"))), F.when(section, tag("T2", col("chapter"))),
            F.lit("ER  - ")))
    return refs.select(key, F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))


NAMED_KINDS = {"label": "L", "description": "D", "alias": "A"}
VALUE_KINDS = ("item", "time", "quantity", "coordinate")


def edit_commands(df: DataFrame, item: str, prop: str, value: str, kind: str = "string", lang: str | None = None,
                  qualifiers: Mapping[str, Column] | None = None, reference_item: str | None = None, reference_url: str | None = None,
                  retrieved: str | None = None, comment: str | None = None, remove: bool = False) -> DataFrame:
    """Add a ``command`` column of edit commands, and ``valid`` (rows with a bad item id carry no command).

    The parts are joined by `` | `` in the order item, property, value, qualifiers,
    references, comment.
    """
    import re

    ids = [p for p in (qualifiers or {}) if not re.fullmatch(r"P\d+", p)]
    if ids or (reference_item and not re.fullmatch(r"Q\d+", reference_item)):
        raise ValueError(f"bad property or item id: {ids or reference_item}")
    if kind not in {*NAMED_KINDS, "string", "monolingual", *VALUE_KINDS}:
        raise ValueError(f"unknown kind {kind}")
    if (kind in NAMED_KINDS or kind == "monolingual") and not lang:
        raise ValueError(f"{kind} needs a language")
    if kind not in NAMED_KINDS and not re.fullmatch(r"P\d+", prop):
        raise ValueError("property must look like P123")
    if (reference_item or reference_url) and not retrieved and kind not in NAMED_KINDS:
        raise ValueError("a reference needs the date it was retrieved")
    v = F.col(value).cast("string")
    quoted = F.concat(F.lit('"'), v, F.lit('"'))
    if kind in NAMED_KINDS:
        parts = [F.lit(NAMED_KINDS[kind] + lang), quoted]
    elif kind == "monolingual":
        parts = [F.lit(prop), F.concat(F.lit(f"{lang}:"), quoted)]
    else:
        parts = [F.lit(prop), quoted if kind == "string" else v]
    for p, q in (qualifiers or {}).items():
        parts += [F.lit("qal" + p[1:]), q.cast("string")]
    if kind not in NAMED_KINDS and (reference_item or reference_url):
        if reference_item:
            parts += [F.lit("S248"), F.lit(reference_item)]
        if reference_url:
            parts += [F.lit("S854"), F.lit(f'"{reference_url}"')]
        parts += [F.lit("S813"), F.lit(f"+{retrieved}T00:00:00Z/11")]
    if comment:
        parts.append(F.lit(f"/* {comment} */"))
    valid = F.coalesce(F.col(item).rlike(r"^Q\d+$") | (F.col(item) == "LAST"), F.lit(False)) & v.isNotNull()
    head = F.concat(F.lit("-"), F.col(item)) if remove else F.col(item)
    return df.withColumn("valid", valid).withColumn("command", F.when(F.col("valid"), F.concat_ws(" | ", head, *parts)))
