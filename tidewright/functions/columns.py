"""Column helpers with the exact null, rounding and ordering rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole in double, rounded half away from zero; null over an empty whole."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def rounded_avg(x: Column, digits: int = 1) -> Column:
    return F.round(F.avg(x.cast("double")), digits)


def yes(x: Column) -> Column:
    """1 where x is true; null counts as false."""
    return F.when(x, 1).otherwise(0)


def count_where(x: Column) -> Column:
    return F.count(F.when(x, F.lit(1)))


def week_label(day: Column) -> Column:
    """Year and Monday-first week of the year, 00 to 53, as 2024-W05 (not the ISO week)."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def preview(text: Column, n: int = 200) -> Column:
    """The first n characters and an ellipsis where the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int) -> Column:
    """The first n characters and always an ellipsis."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def items(json: Column, name: str, value: str = "weight") -> Column:
    """A JSON list of {name, value} as an array; null, empty and unreadable text give an empty one."""
    return F.coalesce(F.from_json(json, f"array<struct<{name}:string,{value}:int>>"), F.from_json(F.lit("[]"), f"array<struct<{name}:string,{value}:int>>"))


def contact(value: Column) -> tuple[Column, Column]:
    """(email, phone): what holds an @ is an email, the other is empty."""
    given = F.coalesce(value, F.lit(""))
    is_email = given.contains("@")
    return F.when(is_email, given).otherwise(""), F.when(is_email, "").otherwise(given)


def normalized(text: Column) -> Column:
    """Lower case, runs of whitespace as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def truncated(x: Column) -> Column:
    """Whole part, towards zero."""
    return x.cast("int")


def percent_text(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("%"))


def minutes_text(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("min"))


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def relative_day(day: Column, as_of: Column) -> Column:
    """Today, Yesterday, N days ago, or the date after a week."""
    gap = F.date_diff(as_of, day)
    return F.when(gap == 0, "Today").when(gap == 1, "Yesterday").when(gap < 7, F.concat(gap.cast("string"), F.lit(" days ago"))).otherwise(day.cast("string"))


def days_running(first: Column, as_of: Column) -> Column:
    """Days since the first one, which counts."""
    return F.date_diff(as_of, first) + 1


def band_colour(accuracy: Column) -> Column:
    return F.when(accuracy >= 80, "good").when(accuracy >= 60, "fair").otherwise("weak")


def skills_preview(skills: Column, n: int = 3) -> Column:
    """The first n names, and how many more there are."""
    names = F.transform(skills, lambda s: s["skill"])
    more = F.size(skills) - n
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
