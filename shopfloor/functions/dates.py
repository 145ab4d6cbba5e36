"""Dates as columns. A date argument may be a Python date, an ISO string or a Column."""

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

DateLike = dt.date | str | Column | None

# Public holidays of Korea for the years the calendar lists in full.
HOLIDAY_YEARS = (2023, 2026)
HOLIDAYS = """
2023-01-01 2023-01-21 2023-01-22 2023-01-23 2023-01-24 2023-03-01 2023-05-05 2023-05-27 2023-06-06 2023-08-15
2023-09-28 2023-09-29 2023-09-30 2023-10-02 2023-10-03 2023-10-09 2023-12-25
2024-01-01 2024-02-09 2024-02-10 2024-02-11 2024-02-12 2024-03-01 2024-04-10 2024-05-05 2024-05-06 2024-05-15
2024-06-06 2024-08-15 2024-09-16 2024-09-17 2024-09-18 2024-10-03 2024-10-09 2024-12-25
2025-01-01 2025-01-27 2025-01-28 2025-01-29 2025-01-30 2025-03-01 2025-03-03 2025-05-05 2025-05-06 2025-06-03
2025-06-06 2025-08-15 2025-10-03 2025-10-05 2025-10-06 2025-10-07 2025-10-08 2025-10-09 2025-12-25
2026-01-01 2026-02-16 2026-02-17 2026-02-18 2026-03-01 2026-03-02 2026-05-05 2026-05-24 2026-05-25 2026-06-06
2026-08-15 2026-08-17 2026-09-24 2026-09-25 2026-09-26 2026-09-28 2026-10-03 2026-10-05 2026-10-09 2026-12-25
""".split()
# Holidays with the same month and day every year, used outside those years.
FIXED_MONTH_DAYS = ["01-01", "03-01", "05-05", "06-06", "08-15", "10-03", "10-09", "12-25"]


def as_date(d: DateLike) -> Column:
    if isinstance(d, Column):
        return d.cast("date")
    if isinstance(d, str):
        d = dt.date.fromisoformat(d[:10])
    return F.lit(d).cast("date")


def max_date(df: DataFrame, col: str) -> Column:
    """Largest date of a frame as a scalar subquery: evaluated once, no driver round trip. Good for
    one equality, which Spark still pushes to the scan."""
    return df.agg(F.max(col).cast("date").alias("d")).scalar()


def date_span(df: DataFrame, col: str) -> tuple[Column, Column, dt.date | None]:
    """Oldest and newest date as literals, and the newest as a value. One small job over one column; in
    return every range built on them is folded, pushed to the scan and pruned to partitions before the
    report starts. A dataset by month is asked for its first and last month, then for their days only."""
    if MONTH in df.columns:
        ends = [m for m in df.agg(F.min(MONTH), F.max(MONTH)).first() if m is not None]
        df = df.filter(F.col(MONTH).isin(ends))
    lo, hi = df.agg(F.min(col).cast("date"), F.max(col).cast("date")).first()
    return as_date(lo), as_date(hi), hi


def newest(df: DataFrame, col: str) -> Column:
    return date_span(df, col)[1]


def add_days(d: DateLike, n: int | Column) -> Column:
    return F.date_add(as_date(d), n)


def within(col: str, start: DateLike, end: DateLike) -> Column:
    """Closed day range written half-open on the raw column, so that it reaches the scan."""
    return (F.col(col) >= as_date(start)) & (F.col(col) < add_days(end, 1))


MONTH = "sales_month"


def month_key(d: DateLike) -> Column:
    return F.date_format(as_date(d), "yyyy-MM")


def prune(df: DataFrame, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Bound the month partition of a stored dataset, so whole directories are skipped. A frame
    without that column is returned as it is."""
    if MONTH in df.columns:
        if start is not None:
            df = df.filter(F.col(MONTH) >= month_key(start))
        if end is not None:
            df = df.filter(F.col(MONTH) <= month_key(end))
    return df


def week_start(d: DateLike) -> Column:
    return F.date_trunc("week", as_date(d)).cast("date")


def month_start(d: DateLike) -> Column:
    return F.trunc(as_date(d), "month")


def year_start(d: DateLike) -> Column:
    return F.trunc(as_date(d), "year")


def bucket(col: str, grain: str) -> Column:
    c = F.col(col).cast("date")
    if grain == "day":
        return c
    if grain == "week":
        return week_start(c)
    if grain == "month":
        return month_start(c)
    raise ValueError(f"unknown grain: {grain}")


def red_days(
    df: DataFrame,
    date_col: str,
    holidays: Iterable[str] = HOLIDAYS,
    years: tuple[int, int] = HOLIDAY_YEARS,
    fixed: Iterable[str] = FIXED_MONTH_DAYS,
) -> DataFrame:
    """Flag Sundays and holidays. Listed days count everywhere; outside the listed years the
    fixed month-days count too. The calendar is a short literal list, so it folds into the
    projection and needs no join."""
    d = F.col(date_col).cast("date")
    listed = d.isin([dt.date.fromisoformat(h) for h in holidays])
    outside = ~F.year(d).between(*years) & F.date_format(d, "MM-dd").isin(list(fixed))
    sunday = F.dayofweek(d) == 1
    holiday = listed | outside
    return df.withColumn("is_sunday", sunday).withColumn("is_holiday", holiday).withColumn("is_red_day", sunday | holiday)
