"""Fixed-layout text lines to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.ordered import forward_fill

NUMBER = r"\d+,\d+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that start with a six-digit area code."""
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*0[1-9]\d{4}\s"))


def parse_lines(df: DataFrame, line: str, n_numbers: int = 11) -> DataFrame:
    """Code, department heading or province and section, place, decimal-comma numbers, tail.

    The text before the first number is either ``DEPARTMENT. Cp. City`` or
    ``Province 2ª s. Place``; the tail starts with a group name when its first
    word is capitalised and has no digit in it.
    """
    raw = F.col(line)
    left = F.trim(F.regexp_extract(raw, rf"^(.*?)(?={NUMBER})", 1))
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(NUMBER), F.lit(0)),
                          lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    out = df.withColumns({
        "code": F.regexp_extract(left, r"(0[1-9]\d{4})", 1),
        "_rest": F.trim(F.regexp_replace(left, r"^0[1-9]\d{4}", "")),
        "_numbers": numbers,
        "_tail": F.trim(F.regexp_extract(raw, rf"(?s)^.*{NUMBER}(.*)$", 1)),
    })
    heading = r"^([A-ZÁÉÍÓÚ][A-ZÁÉÍÓÚ ]{3,}?)[.,]\s+(.+)$"
    section = r"^(.*?)\s*(\d+)ª\s*s\.\s*(.*)"
    rest, tail = F.col("_rest"), F.col("_tail")
    is_head, is_section = rest.rlike(heading), rest.rlike(section)
    group = r"^([A-ZÁÉÍÓÚ][^0-9%ª\s]*)(?:\s|$)"
    has_group = tail.rlike(group)
    out = out.withColumns({
        "department": F.when(is_head, F.regexp_extract(rest, heading, 1)),
        "province": F.when(~is_head & is_section, F.nullif(F.regexp_extract(rest, section, 1), F.lit(""))),
        "section": F.when(is_head, "Cp").when(is_section, F.regexp_extract(rest, section, 2)),
        "place": F.when(is_head, F.trim(F.regexp_replace(F.regexp_extract(rest, heading, 2), r"^(?:Capital|Cp\.?|Cap\.?)\s*", "")))
        .when(is_section, F.regexp_extract(rest, section, 3)).otherwise(rest),
        "group_name": F.when(has_group, F.regexp_extract(tail, group, 1)),
        "remark": F.nullif(F.trim(F.when(has_group, F.regexp_replace(tail, group, "")).otherwise(tail)), F.lit("")),
        **{f"n{i + 1}": F.get(F.col("_numbers"), F.lit(i)) for i in range(n_numbers)},
    })
    return out.drop("_rest", "_numbers", "_tail", line)


def fill_headings(df: DataFrame, order: str) -> DataFrame:
    """Carry the department down all lines, and the province down inside a department.

    Department capitals have no province and do not pass one on.
    """
    filled = forward_fill(df, [], [F.col(order).asc()], {"department": F.col("department")})
    filled = forward_fill(filled, ["department"], [F.col(order).asc()], {"province": F.col("province")})
    return filled.withColumn("province", F.when(F.coalesce(F.col("section") != "Cp", F.lit(True)), F.col("province")))
