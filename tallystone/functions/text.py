"""Text keys and clean-up rules as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that are no marked form of another letter, and what they fold to.
OWN_LETTERS = {
    "Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "TH", "þ": "th", "ß": "ss", "ẞ": "SS", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h",
    "ı": "i", "ĸ": "q", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "ƀ": "b", "Ɓ": "B", "Ɖ": "D", "Ɗ": "D",
    "ƒ": "f", "Ƒ": "F", "Ɠ": "G", "Ɨ": "I", "ɨ": "i", "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N", "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T",
    "ƭ": "t", "Ʈ": "T", "Ʋ": "V", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z", "Ə": "E", "ə": "e", "Ǥ": "G", "ǥ": "g", "Ȥ": "Z", "ȥ": "z", "Ⱥ": "A",
    "Ȼ": "C", "ȼ": "c", "Ƚ": "L", "Ɇ": "E", "ɇ": "e", "Ɉ": "J", "ɉ": "j", "Ɍ": "R", "ɍ": "r", "Ɏ": "Y", "ɏ": "y", "ȷ": "j",
}


def _folding() -> dict[str, str]:
    """Every Latin letter of the first blocks to plain letters: by its decomposition, else by its own entry."""
    out = dict(OWN_LETTERS)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = [p for p in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(p)]
        plain = "".join(OWN_LETTERS.get(p, p) for p in parts)
        if plain != letter and plain.isascii() and plain.isalpha():
            out.setdefault(letter, plain)
    return out


_FOLDS = _folding()
_SINGLE = {k: v for k, v in _FOLDS.items() if len(v) == 1}
_DOUBLE = {k: v for k, v in _FOLDS.items() if len(v) > 1}


def fold_accents(col: Column) -> Column:
    """Latin letters without their marks, composed or not; letters of other scripts stay."""
    bare = F.regexp_replace(col, r"(?<=\p{IsLatin})\p{Mn}+", "")
    out = F.translate(bare, "".join(_SINGLE), "".join(_SINGLE.values()))
    for letter, letters in _DOUBLE.items():
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return out


def pad_zeros(col: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer texts stay whole, unlike with ``lpad``."""
    text = col.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def squish(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def equiv_key(col: Column) -> Column:
    """Equal for texts that differ in case, accents, outer space, NBSP or double quotes."""
    spaced = F.replace(F.trim(col), F.lit("\u00a0"), F.lit(" "))
    return F.lower(F.replace(fold_accents(spaced), F.lit('"'), F.lit("")))


def equivalent(a: Column, b: Column) -> Column:
    return equiv_key(a) == equiv_key(b)


def match_key(col: Column) -> Column:
    """Upper-case key that drops non-ASCII letters instead of folding them."""
    upper = F.upper(squish(col))
    ascii_only = F.regexp_replace(upper, r"[^\x20-\x7E]", "")
    return squish(F.regexp_replace(ascii_only, "[^A-Z0-9 ]", " "))


def title_match_key(col: Column) -> Column:
    """Case- and whitespace-free key for exact title matching."""
    return F.lower(F.regexp_replace(col, r"\s", ""))


def citation_key(title: Column, year: Column, last_name: Column) -> Column:
    """``last|year|title`` with entities, case, accents and punctuation removed."""

    def norm(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        x = F.replace(x, F.lit("&nbsp;"), F.lit(" "))
        x = F.regexp_replace(x, r"&#\d+;", " ")
        return squish(F.regexp_replace(fold_accents(F.lower(x)), "[^a-z0-9 ]", ""))

    return F.concat_ws("|", norm(last_name), norm(year), norm(title))


def title_case(col: Column) -> Column:
    """Capitalise words, also after a hyphen, slash or opening bracket."""
    broken = F.regexp_replace(col, r"([-(/])", "$1\u0001 ")
    return F.replace(F.initcap(broken), F.lit("\u0001 "), F.lit(""))


def apply_rules(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Fold an ordered list of (pattern, replacement) into one expression."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def snake_case(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snake_name(name: str) -> str:
    """The same rule for a column name in the schema."""
    import re

    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))


def split_first(col: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """Split at the first separators, the last column taking the rest."""
    parts = F.split(col, pattern, len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def wiki_slug(url: Column) -> Column:
    """Page name in a wiki link, NULL for other links."""
    return F.nullif(F.replace(F.regexp_extract(url, r"/wiki/([^#?]+)", 1), F.lit("_"), F.lit(" ")), F.lit(""))


def is_latin(col: Column) -> Column:
    """All letters of the text belong to the Latin script."""
    return ~F.regexp_like(col, F.lit(r"(?=\p{L})\P{IsLatin}"))


# Clean-up rules for facility names, in the order they apply.
NAME_TYPOS = [("Facili\\b", "Facility"), ("Processsing", "Processing")]
NAME_EXPANSIONS = [
    (r"\bDept\.?\b", "Department"), (r"\bCtr\.?\b", "Center"), (r"\bCorr\.?\b", "Correctional"),
    (r"\bInst\.?\b", "Institution"), (r"\bFed\.?\b", "Federal"), (r"\bDet\.?\b", "Detention"),
    (r"\bFac\.?\b", "Facility"), (r"\bCo\.?\b", "County"),
]
NAME_ACRONYMS = [
    (r"\bOf\b", "of"), (r"\bUs\b", "US"), (r"\bIce\b", "ICE"), (r"\bEro\b", "ERO"), (r"\bMdc\b", "MDC"),
    (r"\bCca\b", "CCA"), (r"\bFci\b", "FCI"), (r"\bFdc\b", "FDC"), (r"\bJtf\b", "JTF"), (r"\bSsm\b", "SSM"),
    (r"\bTgk\b", "TGK"), (r"\bIpc\b", "IPC"), (r"\bSpc\b", "SPC"), (r"\bIah\b", "IAH"), (r"\bClipc\b", "CLIPC"),
    (r"\bDigsa\b", "DIGSA"), (r"\bIgsa\b", "IGSA"),
]
NAME_STATES = [
    (r"\(Fl\)", "(Florida)"), (r"\(In\)", "(Indiana)"), (r"\(Mo\)", "(Missouri)"), (r"\(Mt\)", "(Montana)"),
    (r"\(Ne\)", "(Nebraska)"), (r"\(Ny\)", "(New York)"), (r"\(Tx\)", "(Texas)"), (r"\(Ut\)", "(Utah)"),
    (r", Nm\b", ", New Mexico"), (r", Mt\b", ", Montana"),
]
# Names that are replaced, in published order.
NAME_FIXES = [
    ("CCA, Florence Correctional Center", "Central Arizona Florence Correctional Complex"),
    ("Eloy Federal Contract Facility", "Eloy Detention Center"),
    ("T Don Hutto Detention Center", "T. Don Hutto Detention Center"),
    ("Torrance/Estancia, New Mexico", "Torrance County Detention Facility"),
    ("Houston Contract Detention Facility", "Houston Processing Center"),
    ("Elizabeth Contract Detention Facility", "Elizabeth Detention Center"),
    ("Folkston D Ray ICE Processing Center", "Folkston ICE Processing Center"),
    ("Robert A Deyton Detention Facility", "Robert A. Deyton Detention Center"),
    ("ERO El Paso Camp East Montana", "Camp East Montana"),
    ("Port Isabel SPC", "Port Isabel Detention Center"),
    ("Bluebonnet Detention Facility", "Bluebonnet Detention Center"),
]
# City spellings that are replaced, in published order.
CITY_FIXES = [
    ("Ft.lauderdale", "Fort Lauderdale"), ("Ft. Lauderdale", "Fort Lauderdale"),
    ("Cottonwood Fall", "Cottonwood Falls"), ("Sault Ste Marie", "Sault Ste. Marie"),
    ("Bunkerhill", "Bunker Hill"), ("Mcelhattan", "McElhattan"), ("Mcfarland", "McFarland"),
    ("Mccook", "McCook"), ("Mccall", "McCall"),
]


def clean_facility_name(col: Column) -> Column:
    rules = NAME_TYPOS + NAME_EXPANSIONS + NAME_ACRONYMS + NAME_STATES + NAME_FIXES
    return apply_rules(title_case(col), rules)


def clean_city_name(col: Column) -> Column:
    return apply_rules(title_case(col), CITY_FIXES)
