"""Calendar periods of reports: ISO weeks and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_id(day: Column) -> Column:
    """``2026-W05`` by ISO 8601."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def month_id(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def local_day(when: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(when, zone))


def days_of_month(period: Column) -> Column:
    """The days of the month ``yyyy-MM``."""
    return F.dayofmonth(F.last_day(F.to_date(F.concat(period, F.lit("-01")))))
