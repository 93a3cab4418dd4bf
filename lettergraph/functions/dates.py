"""Dates as people count them: stamps, working days, list groups, weeks, loose date words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(ts: Column) -> Column:
    """A time as text to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def days_between(start: Column, end: Column) -> Column:
    """Calendar days, never below 0."""
    return F.greatest(F.datediff(end, start), F.lit(0))


def workdays_since(start: Column, end: Column, holidays: list[str] | None = None) -> Column:
    """Mondays to Fridays after ``start`` up to ``end`` that are no holidays; in closed form, without a row a day.

    Days from Monday 1970-01-05 split into weeks of five working days and a rest of at most five.
    """
    epoch = lambda d: F.datediff(d.cast("date"), F.lit("1970-01-05").cast("date"))
    worked = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    count = worked(epoch(end) + 1) - worked(epoch(start) + 1)
    for h in sorted(set(holidays or [])):
        day = F.lit(h).cast("date")
        count = count - F.when((day > start.cast("date")) & (day <= end.cast("date")) & (F.weekday(day) < 5), 1).otherwise(0)
    return F.greatest(count, F.lit(0)).cast("int")


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts.cast("timestamp")).cast("date")


def date_group(ts: Column, today: Column) -> Column:
    """List heading: today, yesterday, this week, last week, this month, else the month."""
    day, monday = ts.cast("date"), F.date_sub(today, F.weekday(today))
    return (
        F.when(day == today, "today").when(day == F.date_sub(today, 1), "yesterday").when((day >= monday) & (day <= today), "this_week")
        .when((day >= F.date_sub(monday, 7)) & (day < monday), "last_week").when(F.date_format(day, "yyyy-MM") == F.date_format(today, "yyyy-MM"), "this_month")
        .otherwise(F.date_format(day, "yyyy-MM"))
    )


def resolve_when(expr: Column, base: Column) -> Column:
    """A loose date word as a date, null when it fixes none.

    today, tomorrow, the day after; month/day in the base's year, or the next when over 60 days gone; a weekday's next
    occurrence, never the base itself; "next week" adds one week to the weekday of this one.
    """
    e = F.replace(expr, F.lit(" "), F.lit(""))
    month, day = F.regexp_extract(e, r"(\d{1,2})(?:/|월)(\d{1,2})", 1), F.regexp_extract(e, r"(\d{1,2})(?:/|월)(\d{1,2})", 2)
    on = lambda year: F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    same = on(F.year(base))
    by_number = F.when(same.isNull(), F.lit(None).cast("date")).when(F.datediff(base, same) > 60, on(F.year(base) + 1)).otherwise(same)
    # The words for today, tomorrow, the day after, next week and the working days.
    index = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(("월요일", "화요일", "수요일", "목요일", "금요일")))):
        index = F.when(F.contains(e, F.lit(name)), i).otherwise(index)
    ahead = F.pmod(index - F.weekday(base), F.lit(7))
    ahead = F.when(F.contains(e, F.lit("다음주")), ahead + 7).when(ahead == 0, 7).otherwise(ahead)
    return (
        F.when(F.contains(e, F.lit("오늘")), base).when(F.contains(e, F.lit("내일")), F.date_add(base, 1)).when(F.contains(e, F.lit("모레")), F.date_add(base, 2))
        .when(month != "", by_number).when(index.isNotNull(), F.date_add(base, ahead.cast("int"))).otherwise(F.lit(None).cast("date"))
    )
