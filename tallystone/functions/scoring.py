"""Ordinal scale, threshold classes and alignment rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group code -> codes of the languages that match the declared group.
GROUP_LANGUAGES = {
    2: [1], 3: [2], 4: [37], 5: [3], 6: [5], 7: [7], 8: [8], 9: [9], 10: [27], 11: [27], 12: [4], 14: [11],
    15: [12], 16: [13], 17: [14], 18: [15], 19: [2], 20: [27], 21: [19], 22: [17], 23: [2], 24: [16], 25: [27],
    26: [2], 27: [18], 28: [19], 29: [20, 21], 30: [20], 31: [21], 32: [22], 33: [23], 34: [24], 35: [25],
    36: [2], 38: [26], 39: [2], 40: [27], 41: [2], 42: [27], 43: [28], 44: [2], 45: [29], 46: [30], 48: [10],
    49: [32], 50: [33], 51: [34], 52: [27], 53: [35], 54: [36], 55: [2, 27],
}
# Generic groups, which accept any indigenous language.
GENERIC_GROUPS = [1, 13, 37, 47, 55, 56, 57, 58]
INDIGENOUS_LANGUAGES = [*range(1, 6), *range(7, 38)]
MAJORITY_LANGUAGE = 6
NO_ANSWER = 999


def group_language_map(pairs: Mapping[int, Sequence[int]] = GROUP_LANGUAGES,
                       generic: Sequence[int] = GENERIC_GROUPS,
                       any_language: Sequence[int] = INDIGENOUS_LANGUAGES) -> Column:
    """The pair table as a literal map, small enough to travel with the expression."""
    table = {**pairs, **{g: list(any_language) for g in generic}}
    flat = chain.from_iterable((F.lit(g), F.array(*[F.lit(x) for x in langs])) for g, langs in sorted(table.items()))
    return F.create_map(*flat)


def indicators(identifies: Column, group: Column, languages: Sequence[Column], mother_tongue: Column) -> dict[str, Column]:
    """q1 identifies, q2 speaks a matching language, q3 learned one as a child, c speaks the majority language.

    A missing language or group never matches. Those who do not identify satisfy
    q2 with any indigenous language.
    """
    spoken = F.array_compact(F.array(*languages))
    q1 = F.coalesce(identifies == 1, F.lit(False))
    wanted = F.try_element_at(group_language_map(), group.cast("int"))
    matches = F.coalesce(F.arrays_overlap(spoken, wanted), F.lit(False))
    any_indigenous = F.arrays_overlap(spoken, F.array(*[F.lit(x) for x in INDIGENOUS_LANGUAGES]))
    return {
        "q1": q1,
        "q2": F.when(q1, matches).otherwise(F.coalesce(any_indigenous, F.lit(False))),
        "q3": F.coalesce(~mother_tongue.isin(MAJORITY_LANGUAGE, NO_ANSWER), F.lit(False)),
        "c": F.array_contains(spoken, MAJORITY_LANGUAGE),
    }


def ordinal_scale(q1: Column, q2: Column, q3: Column, c: Column) -> Column:
    """Ten ordered levels from 0 (none) to 7 (identifies, speaks, learned, no majority language)."""
    return (F.when(q1 & q2 & q3, F.when(c, 6.0).otherwise(7.0))
            .when(q1 & q2, 5.0)
            .when(q1, F.when(q3, 4.5).otherwise(4.0))
            .when(q2 & q3, F.when(c, 2.0).otherwise(3.0))
            .when(q2, 1.0)
            .when(q3, 1.5)
            .otherwise(0.0))


def whole_level(level: Column) -> Column:
    """Half levels count as the level below, for comparison with older tables."""
    return F.floor(level).cast("int")


def identity_type(q1: Column, q2: Column, q3: Column) -> Column:
    return (F.when(~q1, "No identity")
            .when(q2 & q3, "Identity + language + childhood")
            .when(q2, "Identity + language (no childhood)")
            .when(q3, "Identity + childhood (no current language)")
            .otherwise("Identity only"))


def threshold_class(c5: Column, c4: Column, c2: Column, scale: float = 100.0) -> Column:
    """Nine classes A to I, first rule wins; ``scale`` 100 for percent, 1 for proportions."""

    def at(x: float) -> float:
        return x * scale / 100.0

    out = F.when((c5 >= at(90)) & (c4 >= at(90)) & (c2 >= at(90)), "A")
    # Lower bounds of classes B to D on the three shares.
    for label, b5, b4, b2 in (("B", 67, 80, 90), ("C", 50, 67, 67), ("D", 33, 50, 67)):
        out = out.when((c5 > at(b5)) & (c4 > at(b4)) & (c2 > at(b2)), label)
    # Lower bounds of classes E to H on the widest share.
    for label, b2 in (("E", 75), ("F", 50), ("G", 33), ("H", 10)):
        out = out.when(c2 > at(b2), label)
    return out.otherwise("I")


def alignment(language: Column, group: Column, specials: Mapping[str, str],
              same: Mapping[str, str] | None = None, specials_first: bool = True) -> Column:
    """Does the declared group name the language, after known equivalences?

    ``specials`` are group answers with a label of their own; the two published
    variants differ in whether they are tested before or after the name match.
    """
    if same:
        pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(same.items())])
        language = F.coalesce(F.try_element_at(pairs, language), language)
    low_l, low_g = F.lower(language), F.lower(group)
    rules = [(low_g.contains(low_l) | low_l.contains(low_g), "Matching group")]
    named = [(group == k, v) for k, v in specials.items()]
    rules = named + rules if specials_first else rules + named
    out = F.when(rules[0][0], rules[0][1])
    for cond, label in rules[1:]:
        out = out.when(cond, label)
    return out.when(group.isNotNull(), "Different group").otherwise("No identity data")


def current_speaker(languages: Sequence[Column], mother_tongue: Column) -> Column:
    """True or false when any language is known, NULL when none is."""
    spoken = F.array_compact(F.array(*languages))
    return F.when(F.size(spoken) > 0, F.coalesce(F.array_contains(spoken, mother_tongue), F.lit(False)))


def speaker_status(is_current: Column) -> Column:
    return F.when(is_current, "Current speaker").when(~is_current, "Heritage only")


def suppress_small(rate: Column, base: Column, minimum: int) -> Column:
    """The rate only where its denominator is large enough."""
    return F.when(base >= minimum, rate)


# Facility types by substring of the agreement name, published order.
FACILITY_TYPES = [
    ("IGSA", "Jail"), ("USMS IGA", "Jail"), ("DIGSA", "Dedicated Migrant Detention Center"),
    ("STATE", "State Migrant Detention Center"), ("BOP", "Federal Prison"),
    ("Family", "Private Family Detention Center"), ("CDF", "Private Migrant Detention Center"),
    ("USMS CDF", "Private Migrant Detention Center"), ("SPC", "ICE Migrant Detention Center"),
    ("STAGING", "ICE Short-Term Migrant Detention Center"), ("DOD", "Military Detention Center"),
]
# The same rules with the longer names tested before the names they contain.
FACILITY_TYPES_BY_LENGTH = sorted(FACILITY_TYPES, key=lambda rule: -len(rule[0]))


def first_rule(col: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first rule whose text the column contains."""
    out = F.when(col.contains(rules[0][0]), rules[0][1])
    for text, label in rules[1:]:
        out = out.when(col.contains(text), label)
    return out.otherwise(otherwise)
