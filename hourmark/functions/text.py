"""Identifiers, names and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourmark import schema as S


def harmonise_unit(unit: Column) -> Column:
    """One spelling per known unit, other units trimmed."""
    trimmed = F.trim(unit)
    upper = F.upper(trimmed)
    result = F.when(F.lit(False), trimmed)
    for spelling, unified in S.UNIT_SPELLINGS.items():
        result = result.when(upper == spelling, F.lit(unified))
    return result.otherwise(trimmed)


def underscore_spaces(parameter: Column) -> Column:
    return F.replace(parameter, F.lit(" "), F.lit("_"))


def public_id(raw_id: Column) -> Column:
    """`site_N` of a raw id that carries a name behind it, else the raw id."""
    return F.when(raw_id.rlike(S.SITE_PREFIX), F.regexp_extract(raw_id, S.SITE_ID, 1)).otherwise(raw_id)


def has_own_name(raw_id: Column, name: Column) -> Column:
    return name.isNotNull() & (name != raw_id)


def display_name(raw_id: Column, name: Column) -> Column:
    """The given name unless it is missing or repeats the id; then what follows the site prefix."""
    return F.when(has_own_name(raw_id, name), name).otherwise(F.regexp_replace(raw_id, S.SITE_PREFIX, ""))


def name_key(name: Column) -> Column:
    """Lower-case letters and digits of a name without its closing ` - agency`."""
    place = F.lower(F.regexp_replace(name, S.AGENCY_SUFFIX, ""))
    return F.regexp_replace(place, S.NOT_KEY_CHARACTER, "")


def network(station_id: Column) -> Column:
    return F.when(station_id.startswith(S.FIXED_ID_PREFIX), F.lit(S.FIXED_NETWORK)).otherwise(
        F.lit(S.MAIN_NETWORK)
    )


def strip(text: Column) -> Column:
    """Trim every kind of white space, not spaces only; blank becomes null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+\z", "")
    return F.nullif(bare, F.lit(""))


def to_number(text: Column) -> Column:
    """A double, or null where the text is not a number."""
    bare = F.lower(strip(text))
    number = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)\z"
    return F.when(bare.rlike(number), bare.try_cast("double"))
