"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dummy columns, one per month but December.
MONTH_NAMES = {
    "April": 4,
    "August": 8,
    "February": 2,
    "January": 1,
    "July": 7,
    "June": 6,
    "March": 3,
    "May": 5,
    "November": 11,
    "October": 10,
    "September": 9,
}
DUMMIES = list(MONTH_NAMES)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "QUARTER").cast("date")


def ceil_month(day: Column) -> Column:
    """The first month start on or after ``day``."""
    first = month_start(day)
    return F.when(F.dayofmonth(day) == 1, day).otherwise(F.add_months(first, 1))


def parse_date(text: Column, pattern: str) -> Column:
    """Text to DATE; a bad date fails the job, as it would in the source system."""
    return F.to_date(text, pattern)


def parse_quarter(text: Column) -> Column:
    """``Q/YYYY`` to the first day of the quarter."""
    pattern = r"^(\d{1})/(\d{4})$"
    quarter = F.regexp_extract(text, pattern, 1).cast("int")
    year = F.regexp_extract(text, pattern, 2).cast("int")
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def utc_date(text: Column) -> Column:
    """Offset timestamp text to its UTC calendar date, whatever the session zone."""
    return F.to_date(F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone()))


def horizon(ref: Column, survey: Column, unit_days: int) -> Column:
    """Whole units between two dates, truncated toward zero."""
    return (F.datediff(ref, survey) / F.lit(float(unit_days))).cast("int")


def english_month(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def month_dummies(day: Column) -> list[Column]:
    """0/1 columns for every month but December."""
    return [(F.month(day) == k).cast("int").alias(name) for name, k in MONTH_NAMES.items()]
