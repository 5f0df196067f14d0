"""Date and period expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(ts: Column) -> Column:
    """``yyyy-MM-dd`` text; the cast prints dates that way without a formatter."""
    return F.to_date(ts).cast("string")


def month_label(d: Column) -> Column:
    """``MM-yyyy`` text, NULL for a NULL date. Text order is not calendar order."""
    return F.date_format(d, "MM-yyyy")


def month_start(ts: Column) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(ts, "MM")


def quarter_token(year: Column, quarter: Column, separator: str = "-") -> Column:
    """``Q<separator>YYYY`` text, e.g. ``4-2022``."""
    return F.concat(quarter, F.lit(separator), year)


def parse_day_month_year(text: Column) -> Column:
    """DATE from ``d/m/yyyy`` text; NULL where the text is no such date."""
    return F.try_to_date(text, "d/M/yyyy")


def days_since(d: Column, as_of: date | None = None) -> Column:
    """Whole days from ``d`` to ``as_of`` (today when not given)."""
    end = F.current_date() if as_of is None else F.lit(as_of)
    return F.datediff(end, d)


def age_years(birth: Column, as_of: date | None = None) -> Column:
    """Completed years, counting 365.25 days to the year."""
    return F.floor(days_since(birth, as_of) / F.lit(365.25)).cast("int")
