"""Numeric and time coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_number(c: Column) -> Column:
    """Null, NaN and the infinities become 0; strings are cast when they hold a number."""
    d = c.try_cast("double")
    # NaN sorts above infinity, and a null is not below it.
    return F.when(F.abs(d) < float("inf"), d).otherwise(F.lit(0.0))


def token_count(c: Column) -> Column:
    """A token field as a long; a fraction is cut off."""
    return finite_number(c).cast("long")


def epoch_to_ts(c: Column, fallback: Column | None = None) -> Column:
    """Epoch seconds or milliseconds, told apart by magnitude; non-positive gives the fallback."""
    d = c.try_cast("double")
    ms = F.when(d > 10_000_000_000, d).otherwise(d * 1_000).cast("long")
    good = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < 8.64e15)
    return F.when(good, F.timestamp_millis(ms)).otherwise(
        fallback if fallback is not None else F.lit(None).cast("timestamp")
    )


def epoch_ms(c: Column) -> Column:
    """Epoch seconds or milliseconds as milliseconds, missing counting as 0."""
    d = finite_number(c)
    return F.when(d > 10_000_000_000, d).otherwise(d * 1_000).cast("long")



def safe_ts(c: Column, fallback: Column | None = None) -> Column:
    """Parse an ISO instant at millisecond precision, or give the fallback.

    Plain numbers are epoch times; a time without a date is no instant.
    """
    dated = F.when(c.rlike(r"^\d{4}-"), F.timestamp_millis(F.unix_millis(F.try_to_timestamp(c))))
    ts = F.when(c.rlike(r"^\d{5,}(\.\d+)?$"), epoch_to_ts(c)).otherwise(dated)
    return F.coalesce(ts, fallback) if fallback is not None else ts


def clamp_percent(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), d))
    )


def non_negative(c: Column) -> Column:
    """A count for reporting: missing is 0 and negatives are 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(c, F.lit(0).cast("long")))


def usage_struct(
    inp: Column, cached: Column, cache_write: Column, out: Column, reasoning: Column, total: Column
) -> Column:
    """The six token counts with the subsets held inside their wholes."""
    return F.struct(
        inp.alias("input_tokens"),
        F.least(inp, cached).alias("cached_input_tokens"),
        cache_write.alias("cache_write_input_tokens"),
        out.alias("output_tokens"),
        F.least(out, reasoning).alias("reasoning_tokens"),
        total.alias("total_tokens"),
    )


def has_breakdown(inp: Column, out: Column, total: Column) -> Column:
    """Whether input and output explain the total."""
    zero = F.lit(0)
    i, o, t = F.coalesce(inp, zero), F.coalesce(out, zero), F.coalesce(total, zero)
    return (t == 0) | ((i + o == t) & ((i > 0) | (o > 0)))


def hash_id(c: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)


def local_date(ts: Column, tz: str) -> Column:
    """Calendar date of an instant in an IANA zone."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def zoned_midnight(day: Column, tz: str) -> Column:
    """UTC instant at which a local calendar day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)
