"""Dates of the catalogs: vague text, ISO text and day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.text import BLANK

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
EPOCH = "1957-01-01"


# Text is read by patterns that skip blanks themselves, so that each expression holds its input few times.
_VAGUE = rf"^[{BLANK}]*(\d{{4}})\s+([A-Za-z]{{3}})\s+(\d{{1,2}})"


def _month(name: Column) -> Column:
    """01 to 12 of a name as written in MONTHS, case included; else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")]), name)


def iso_date(c: Column) -> Column:
    """'1957 Oct  4 ...' as '1957-10-04'; the day isn't checked. Other text, and unknown months, are null."""
    part = lambda i: F.regexp_extract(c, _VAGUE, i)
    return F.concat(part(1), F.lit("-"), _month(part(2)), F.lit("-"), F.lpad(part(3), 2, "0"))


def year_text(iso: Column) -> Column:
    return F.nullif(F.regexp_extract(iso, r"^(\d{4})", 1), F.lit(""))


def year_number(iso: Column) -> Column:
    return year_text(iso).cast("int")


def month_number(iso: Column) -> Column:
    """1 to 12, else null."""
    m = F.split_part(iso, F.lit("-"), F.lit(2)).try_cast("int")
    return F.when(m.between(1, 12), m)


def _from_epoch(month_start: Column, day: Column) -> Column:
    """Days from the epoch to a day of a month; a day beyond its end runs into the next one."""
    return F.datediff(F.date_add(month_start.try_cast("date"), day - 1), F.lit(EPOCH).cast("date"))


def day_number(iso: Column) -> Column:
    """Days from 1957-01-01 to an ISO date; days 1 to 31 count from the month's start, others are null."""
    day = F.regexp_extract(iso, r"^\d{4}-\d{2}-(0[1-9]|[12]\d|3[01])$", 1).try_cast("int")
    return _from_epoch(F.concat(F.substring(iso, 1, 7), F.lit("-01")), day)


def decay_day_number(c: Column) -> Column:
    """Days from 1957-01-01 to a vague date: 'year month day' (an unknown month is January), else the year's start."""
    full = rf"^[{BLANK}]*\d{{4}}\s+([A-Za-z]{{3}})\s+(\d{{1,6}})"
    year = F.regexp_extract(c, rf"^[{BLANK}]*(\d{{4}})", 1)
    month = F.coalesce(_month(F.regexp_extract(c, full, 1)), F.lit("01"))
    day = F.coalesce(F.regexp_extract(c, full, 2).try_cast("int"), F.lit(1))
    return _from_epoch(F.concat(year, F.lit("-"), month, F.lit("-01")), day)


def day_to_date(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), day)


def day_to_year(day: Column) -> Column:
    return F.year(day_to_date(day))
