"""Text functions with the null rules of pasted labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(x: Column) -> Column:
    """Text of a value; null reads NA."""
    return F.coalesce(x.cast("string"), F.lit("NA"))


def paste(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *map(shown, parts))


def between(text: Column, first: int, last: int) -> Column:
    """Characters first to last, counted from 1, both included."""
    return F.substring(text, first, last - first + 1)


def return_period(years: Column) -> Column:
    """The label of a return period; both blanks around the number are part of it."""
    return paste(F.lit("1 in "), years.cast("bigint"), F.lit(" yr"))


def thousands(x: Column, decimals: int | Column = 0) -> Column:
    return F.format_number(x, decimals)


def three_figures(x: Column) -> Column:
    """Three significant figures with thousands separators."""
    from tamarisk.functions.stats import significant

    places = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.abs(F.when(x != 0, x)))).cast("int"))
    return F.call_function("format_number", significant(x), F.coalesce(places, F.lit(0)))


def percent(x: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.format_number(F.round(x * 100), 0), F.lit("%"))


def in_thousands(x: Column) -> Column:
    return F.concat(F.format_number(F.round(x / 1000), 0), F.lit("k"))


def title_case(x: Column) -> Column:
    """Each word with a capital and small letters after it."""
    return F.initcap(x)


def recode(x: Column, names: dict[str, str]) -> Column:
    """Values by other names; those without one stay."""
    out = x
    for old, new in names.items():
        out = F.when(x == old, new).otherwise(out)
    return out
