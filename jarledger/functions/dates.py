"""Day keys and chart / feed date texts.

Timestamps are wall-clock UTC (TIMESTAMP_NTZ); a day is its UTC calendar date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chart's English weekday and month abbreviations.
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def day_key(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts)


def weekday_label(day: Column) -> Column:
    """'Mon', 'Tue', ... (English short weekday; dayofweek is 1 for Sunday)."""
    return F.element_at(_names(WEEKDAYS), F.dayofweek(day))


def month_day_label(day: Column) -> Column:
    """Day of month without padding: '5'."""
    return F.dayofmonth(day).cast("string")


def day_month_label(day: Column) -> Column:
    """'5 Jan'."""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(_names(MONTHS), F.month(day)))


def time_text_named(ts: Column, is_today: Column, today_label: Column, day_mark: Column, months: Column) -> Column:
    """Feed time on a 24-hour clock with the language's own month names:
    'Heute, 15:07' for today's rows, else '20. Jan., 15:07'."""
    day = F.concat(F.dayofmonth(ts).cast("string"), day_mark, F.lit(" "), F.element_at(months, F.month(ts)))
    return F.concat(F.when(is_today, today_label).otherwise(day), F.lit(", "), F.date_format(ts, "HH:mm"))


def time_text_en(ts: Column, is_today: Column, today_label: str | Column | None = "Today") -> Column:
    """English feed time: 'Today, 03:07 PM' for today's rows, else 'Jan 5, 03:07 PM'."""
    clock = F.date_format(ts, "hh:mm a")
    other = F.date_format(ts, "MMM d, hh:mm a")
    if today_label is None:
        return other
    label = F.lit(today_label) if isinstance(today_label, str) else today_label
    return F.when(is_today, F.concat(label, F.lit(", "), clock)).otherwise(other)
