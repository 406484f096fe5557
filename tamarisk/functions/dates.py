"""Dates, rainy seasons, dekads and day indices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First day of the daily flood record, season months, their dekads.
ORIGIN = date(1998, 1, 12)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SEASON_MONTHS = ("October", "November", "December", "January", "February", "March")
DEKADS = ("01", "11", "21")
#: The 18 month-and-dekad labels in season order.
MONTH_DEKADS = tuple(f"{m[:3]} {d}" for m in SEASON_MONTHS for d in DEKADS)


def from_index(days: Column, origin: date = ORIGIN) -> Column:
    return F.date_add(F.lit(origin), days.cast("int"))


def to_index(day: Column, origin: date = ORIGIN) -> Column:
    return F.datediff(day, F.lit(origin))


def as_date(x: Column) -> Column:
    """Text as a date; what is no date becomes null."""
    return F.try_to_date(x)


def month_name(month: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), month - 1)


def month_abbreviation(month: Column) -> Column:
    return F.substring(month_name(month), 1, 3)


def rain_season(day: Column) -> Column:
    """MAM or OND or other, with the year."""
    month = F.month(day)
    return F.concat(F.when(month.isin(3, 4, 5), "MAM").when(month.isin(10, 11, 12), "OND").otherwise("other"), F.lit("_"), F.year(day).cast("string"))


def cross_year_season(year: Column, month: Column) -> Column:
    """YYYY/YYYY+1 for October to December, YYYY-1/YYYY for January to March, null else."""
    span = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    return F.when(month.between(10, 12), span(year, year + 1)).when(month.between(1, 3), span(year - 1, year))


def ordinal(x: Column, levels: tuple[str, ...]) -> Column:
    """Place of x among ordered levels, from 1; null for any other value."""
    at = F.array_position(F.array(*map(F.lit, levels)), x)
    return F.when(at > 0, at.cast("int"))


def season_columns(df: DataFrame, day: str = "date") -> DataFrame:
    """Adds dekad_start, month, yr, month_name, month_abb and season from dates written yyyy-MM-dd."""
    text = F.col(day)
    year, month = F.substring(text, 1, 4).try_cast("int"), F.substring(text, 6, 2).try_cast("int")
    return df.withColumns({"dekad_start": F.substring(text, 9, 2), "month": month, "month_name": month_name(month), "month_abb": month_abbreviation(month), "yr": year, "season": cross_year_season(year, month)})


def day_sequence(lo: Column, hi: Column) -> Column:
    return F.sequence(lo, hi, F.expr("interval 1 day"))


def layer_lookup(days: DataFrame, day: str = "date") -> DataFrame:
    """For each layer date: fs_name, fs_mo, fs_yr, yr_int, fs_seas."""
    d = F.col(day)
    return days.select(d.alias("fs_name"), F.trunc(d, "month").alias("fs_mo"), F.trunc(d, "year").alias("fs_yr"), F.year(d).alias("yr_int"), rain_season(d).alias("fs_seas"))
