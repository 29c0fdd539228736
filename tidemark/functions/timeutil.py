"""Time ranges, buckets and calendar spines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Period:
    """Closed interval [start, end] and the equally long one before it. Both ends are inclusive,
    so an event at ``start`` belongs to both periods."""

    start: datetime
    end: datetime

    @property
    def prev_start(self) -> datetime:
        return self.start - (self.end - self.start)

    @property
    def prev_end(self) -> datetime:
        return self.start

    def current(self, col: Column) -> Column:
        return col.between(ts(self.start), ts(self.end))

    def previous(self, col: Column) -> Column:
        return col.between(ts(self.prev_start), ts(self.prev_end))

    def either(self, col: Column) -> Column:
        return col.between(ts(self.prev_start), ts(self.end))


def ts(value: datetime | str) -> Column:
    """Literal of the canonical instant type."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def slot(x: Column, width: int) -> Column:
    """Number of the ``width``-long slice of a whole-number axis that holds x; exact for any size and sign."""
    return ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("bigint")


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col).cast("timestamp_ntz")


def seconds_between(a: Column, b: Column) -> Column:
    """Count of second boundaries crossed from ``a`` to ``b``."""
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def whole_seconds(a: Column, b: Column) -> Column:
    """Elapsed time truncated to seconds."""
    return slot(micros(b) - micros(a), 1_000_000)


def resolve_period(as_of: datetime, key: str = "7d", start: datetime | None = None, end: datetime | None = None) -> Period:
    """Named range ending at ``as_of``, or an explicit one; an unknown name is an error."""
    if start is not None and end is not None:
        return Period(start, end)
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    month = midnight.replace(day=1)
    rolling = {
        "30min": timedelta(minutes=30), "lastHour": timedelta(hours=1), "24h": timedelta(hours=24),
        "last24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30),
        "90d": timedelta(days=90), "12m": timedelta(days=365),
    }
    if key == "today":
        return Period(midnight, as_of)
    if key == "yesterday":
        return Period(midnight - timedelta(days=1), midnight - timedelta(microseconds=1))
    if key in ("3m", "6m"):
        return Period(months_back(midnight, int(key[0])), as_of)
    if key == "monthToDate":
        return Period(month, as_of)
    if key == "lastMonth":
        return Period(months_back(month, 1), month - timedelta(microseconds=1))
    if key == "yearToDate":
        return Period(month.replace(month=1), as_of)
    if key == "lastYear":
        year = month.replace(month=1)
        return Period(year.replace(year=year.year - 1), year - timedelta(microseconds=1))
    if key not in rolling:
        raise ValueError(f"unknown range {key!r}")
    return Period(as_of - rolling[key], as_of)


def months_back(day: datetime, n: int) -> datetime:
    index = day.year * 12 + day.month - 1 - n
    year, month = divmod(index, 12)
    for last in (day.day, 30, 29, 28):
        try:
            return day.replace(year=year, month=month + 1, day=last)
        except ValueError:
            continue
    raise ValueError(day)


def resolve_interval(interval: str | None, key: str = "7d") -> str:
    """Explicit bucket size, or the one that suits the range."""
    if interval in ("minute", "hour", "day", "week", "month"):
        return interval
    if key in ("30min", "lastHour"):
        return "minute"
    if key in ("today", "24h", "last24h", "yesterday"):
        return "hour"
    if key in ("6m", "12m", "yearToDate", "lastYear"):
        return "month"
    return "day"


def bucket(col: Column, interval: str) -> Column:
    """Start of the bucket; weeks start on Sunday."""
    if interval == "week":
        day = F.to_date(col)
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    return F.date_trunc(interval, col).cast("timestamp_ntz")


def event_months(period: Period) -> list[int]:
    """yyyymm values the period touches, for pruning a month-partitioned table."""
    out, cur = [], period.start.year * 12 + period.start.month - 1
    last = period.end.year * 12 + period.end.month - 1
    while cur <= last:
        out.append(cur // 12 * 100 + cur % 12 + 1)
        cur += 1
    return out


_STEP = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY",
         "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}


def spine(groups: DataFrame, period: Period, interval: str, name: str = "bucket") -> DataFrame:
    """Every group row × every bucket of the period. ``groups`` holds one row per series; the bucket
    list is a literal array, so the row count is series × buckets whatever the fact table holds."""
    lo, hi = bucket(ts(period.start), interval), bucket(ts(period.end), interval)
    return groups.select("*", F.explode(F.sequence(lo, hi, F.expr(_STEP[interval]))).alias(name))


def zero_fill(series: DataFrame, groups: DataFrame, keys: list[str], values: list[str], period: Period,
              interval: str, name: str = "bucket") -> DataFrame:
    """Series joined onto the full spine, absent values as 0."""
    full = spine(groups.select(*keys), period, interval, name)
    return full.join(series.select(*keys, name, *values), [*keys, name], "left").fillna(0, values)
