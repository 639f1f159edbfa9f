"""Address formatting and ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def result_number(wanted: Column) -> Column:
    """The number of the query, never of the hit."""
    return blank(wanted)


def result_unit(hit_unit: Column, wanted: Column) -> Column:
    """The hit's unit, if the query had one."""
    return F.when(blank(wanted) != "", blank(hit_unit)).otherwise(F.lit(""))


def full_street_address(street: Column, number: Column, unit: Column, country: Column, languages: Column) -> Column:
    """Without a number the street alone; number first where English or French is spoken, save in `be`; then the unit."""
    first = (blank(country) != "be") & F.coalesce(F.arrays_overlap(languages, F.array(F.lit("en"), F.lit("fr"))), F.lit(False))
    both = F.when(first, F.concat_ws(" ", number, street)).otherwise(F.concat_ws(" ", street, number))
    with_unit = F.when(blank(unit) != "", F.concat_ws(" ", both, unit)).otherwise(both)
    return F.when(blank(number) == "", blank(street)).otherwise(with_unit)


def floor2(c: Column) -> Column:
    return F.floor(c * 100) / 100


def concat_id(*parts: Column) -> Column:
    """Parts without separators, so that ids can collide; kept as the sources have it."""
    return F.concat(*map(blank, parts))


def hash_id(*parts: Column) -> Column:
    """A hash of the parts, kept apart by a character that none of them holds."""
    return F.md5(F.concat_ws("\x1f", *parts))
