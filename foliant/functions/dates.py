"""Dates as ISO strings with a precision: a day 31 is legal in any month, so they are never cast to DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = {"year": 4, "month": 7, "day": 10}


def parse_loose(text: Column) -> Column:
    """Struct of iso and precision from year, year-month or year-month-day with - / or . between; else null.
    A month or day that is no number lowers the precision; one out of range, or a fourth part, gives null."""
    parts = F.split(F.translate(F.trim(text), "/.", "--"), "-")
    number = lambda k: F.get(parts, k).try_cast("int")
    year, month, day = number(0), number(1), number(2)
    precision = F.when(month.isNull(), "year").when(day.isNull(), "month").otherwise("day")
    sound = F.size(parts).between(1, 3) & year.between(0, 9999) & F.coalesce(month.between(1, 12), F.lit(True)) & F.coalesce(month.isNull() | day.between(1, 31), F.lit(True))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    iso = F.concat(pad(year, 4), F.lit("-"), pad(F.coalesce(month, F.lit(1)), 2), F.lit("-"), F.when(month.isNull(), "01").otherwise(pad(F.coalesce(day, F.lit(1)), 2)))
    return F.when(sound, F.struct(iso.alias("iso"), precision.alias("precision")))


def display(iso: Column, precision: Column, approximate: Column) -> Column:
    """As much of the date as is known, ~ in front if it is approximate."""
    shown = F.when(precision == "year", F.substring(iso, 1, 4)).when(precision == "month", F.substring(iso, 1, 7)).otherwise(F.substring(iso, 1, 10))
    return F.when(iso.isNotNull(), F.concat(F.when(approximate, "~").otherwise(""), shown))


def edit(text: Column) -> Column:
    """State of an edited date: clear for an empty one, set with the parsed value, or invalid."""
    parsed = parse_loose(text)
    return F.struct(F.when(text.isNull(), "keep").when(F.trim(text) == "", "clear").when(parsed.isNull(), "invalid").otherwise("set").alias("state"), parsed.alias("value"))


def draft(iso: Column, precision: Column) -> Column:
    """The known part of a date for editing, empty for none; saved as it is, it changes nothing."""
    return F.coalesce(display(iso, precision, F.lit(False)), F.lit(""))
