"""Reporting windows and the filters that apply them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.keys import MAX_WINDOW_DAYS


@dataclass(frozen=True)
class Bounds:
    """A half-open window of instants; day windows also carry their first and last local date."""

    start: datetime
    end: datetime
    tz: str
    days: int
    first_day: date | None = None
    last_day: date | None = None

    @property
    def start_ms(self) -> int:
        return round(self.start.timestamp() * 1_000)

    @property
    def end_ms(self) -> int:
        return round(self.end.timestamp() * 1_000)


def _zone(tz: str) -> ZoneInfo:
    try:
        return ZoneInfo(tz)
    except (ZoneInfoNotFoundError, ValueError) as error:
        raise ValueError(f"Unknown IANA timezone: {tz}") from error


def _utc(moment: datetime) -> datetime:
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).astimezone(UTC)


def midnight(day: date, tz: str) -> datetime:
    """UTC instant at which a local day begins."""
    return datetime.combine(day, time(), _zone(tz)).astimezone(UTC)


def parse_day(value: str | date, tz: str, now: datetime | None = None) -> date:
    """A date, `YYYY-MM-DD`, `today` or `yesterday`; impossible dates are refused."""
    if isinstance(value, date) and not isinstance(value, datetime):
        return value
    if value in ("today", "yesterday"):
        here = _utc(now or datetime.now(UTC)).astimezone(_zone(tz)).date()
        return here if value == "today" else here - timedelta(days=1)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(value), re.ASCII):
        raise ValueError("Day must be YYYY-MM-DD, today, or yesterday.")
    try:
        return date.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"Invalid calendar day: {value}") from error


def _check_days(days: int) -> int:
    if not isinstance(days, int) or isinstance(days, bool) or not 1 <= days <= MAX_WINDOW_DAYS:
        raise ValueError(f"Window must be between 1 and {MAX_WINDOW_DAYS} days.")
    return days


def multi_day_window(
    value: str | date, tz: str, days: int, now: datetime | None = None
) -> Bounds:
    """N local days ending on the given day."""
    _check_days(days)
    _zone(tz)
    last = parse_day(value or "today", tz, now)
    first = last - timedelta(days=days - 1)
    return Bounds(
        midnight(first, tz), midnight(last + timedelta(days=1), tz), tz, days, first, last)


def day_window(value: str | date, tz: str, now: datetime | None = None) -> Bounds:
    """One local day."""
    return multi_day_window(value, tz, 1, now)


def week_window(value: str | date, tz: str, now: datetime | None = None) -> Bounds:
    """Seven local days ending on the given day."""
    return multi_day_window(value, tz, 7, now)


def rolling_window(now: datetime, days: int = 1, tz: str = "UTC") -> Bounds:
    """The last N × 24 hours: instants, not calendar days."""
    _check_days(days)
    _zone(tz)
    end = _utc(now)
    return Bounds(end - timedelta(hours=24 * days), end, tz, days)


def prior_window(b: Bounds) -> Bounds:
    """The same number of days directly before."""
    if b.first_day is None:
        return replace(b, start=b.start - (b.end - b.start), end=b.start)
    span = timedelta(days=b.days)
    first = b.first_day - span
    return replace(b, start=midnight(first, b.tz), end=b.start, first_day=first,
                   last_day=b.last_day - span)


def in_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Rows with start ≤ time ≤ end, both found by a query; stored event dates prune partitions."""
    out = df.filter((F.col(ts) >= start) & (F.col(ts) <= end))
    if "event_date" in df.columns:
        out = out.filter(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    return out


def in_window(df: DataFrame, b: Bounds, ts: str = "ts") -> DataFrame:
    """Rows with start ≤ time < end; stored event dates prune partitions as well."""
    out = df.filter((F.col(ts) >= F.lit(b.start)) & (F.col(ts) < F.lit(b.end)))
    if "event_date" in df.columns:
        out = out.filter(
            F.col("event_date").between(F.lit(b.start.date()), F.lit(b.end.date())))
    return out
