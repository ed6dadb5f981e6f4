"""The meter as a report shows it: carried points, even grids, bin readings, resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.models import RATE_CARD, Rate, event_credits
from meterlake.functions.numbers import local_date
from meterlake.keys import ACCOUNT
from meterlake.operators.burn import _bin_of, bin_days
from meterlake.operators.meter import ORDER, current_meter
from meterlake.operators.scan import Running, even_ranges, running
from meterlake.operators.windows import Bounds, in_range


def resets(tl: DataFrame, b: Bounds) -> DataFrame:
    """Beginnings of cycles after the first, by their inferred start inside the window."""
    return tl.filter(
        F.col("reset") & (F.col("ts") < F.lit(b.end))
        & (F.col("cycle_start_ts") >= F.lit(b.start)) & (F.col("cycle_start_ts") < F.lit(b.end))
    ).select(ACCOUNT, F.col("cycle_start_ts").alias("ts"), F.col("ts").alias("observed_at"),
             "cycle", F.col("reset_kind").alias("kind"))


def reset_counts(found: DataFrame) -> DataFrame:
    """Scheduled and early resets per account."""
    return found.groupBy(ACCOUNT).agg(
        F.count_if(F.col("kind") == "weekly-expiry").alias("scheduled"),
        F.count_if(~F.col("kind").isin("weekly-expiry", "start")).alias("early"))


def display_points(points: DataFrame, b: Bounds) -> DataFrame:
    """Points inside the window, the last earlier one carried to its start, and the last repeated
    at its end."""
    rest = [c for c in points.columns if c not in (ACCOUNT, "ts")]
    start, end = F.lit(b.start), F.lit(b.end)
    order = F.struct("cycle", *ORDER)
    row = F.struct("ts", *rest)

    def at(df: DataFrame, when: Column, seen: Column) -> DataFrame:
        return df.select(ACCOUNT, when.alias("ts"), *[F.col(f"r.{c}").alias(c) for c in rest],
                         seen.alias("observed"), (~seen).alias("carried"))

    carried = points.filter(F.col("ts") <= start).groupBy(ACCOUNT).agg(
        F.max_by(row, order).alias("r"))
    inside = points.filter((F.col("ts") > start) & (F.col("ts") < end)).select(
        ACCOUNT, "ts", *rest, F.lit(True).alias("observed"), F.lit(False).alias("carried"))
    last = points.filter(F.col("ts") < end).groupBy(ACCOUNT).agg(F.max_by(row, order).alias("r"))
    return (
        at(carried, start, F.col("r.ts") == start)
        .unionByName(inside)
        .unionByName(at(last, end, F.lit(False)))
    )


def resample_meter(points: DataFrame, found: DataFrame, b: Bounds, n: int) -> DataFrame:
    """``n`` instants evenly over the window with the last point at or before each.

    A sample shows 100 when a reset fell after the sample before it.
    """
    span = b.end_ms - b.start_ms
    step = F.lit(span) / F.lit(max(1, n - 1))
    accounts = points.select(ACCOUNT).distinct()
    grid = accounts.select(ACCOUNT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    micros = F.lit(b.start_ms) * 1_000 + F.floor(F.col("sample") * step * 1_000)
    samples = grid.select(
        ACCOUNT, F.timestamp_micros(micros.cast("long")).alias("at"), F.lit(2).alias("kind"),
        "sample")
    seen = points.select(
        ACCOUNT, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("cycle").alias("tie"),
        F.col("resets_at").alias("tie2"),
        F.struct("remaining_percent", F.col("ts").alias("point_ts")).alias("point"))
    marks = found.select(ACCOUNT, F.col("ts").alias("at"), F.lit(0).alias("kind"),
                         F.col("ts").alias("mark"))
    both = samples.unionByName(seen, allowMissingColumns=True).unionByName(
        marks, allowMissingColumns=True)
    order = ["at", "kind", "tie", "tie2"]
    run = running(
        even_ranges(both, [ACCOUNT], order, "marks"), [ACCOUNT], "_chunk", order,
        {"p": Running("last", F.col("point")), "m": Running("last", F.col("mark"))})
    before = F.when(
        F.col("sample") == 0, F.lit(b.start_ms) * 1_000 - 1_000
    ).otherwise(F.lit(b.start_ms) * 1_000 + F.floor((F.col("sample") - 1) * step * 1_000))
    reset = F.coalesce(F.unix_micros("m") > before, F.lit(False))
    return run.filter("kind = 2").select(
        ACCOUNT, "sample", F.col("at").alias("ts"), reset.alias("reset"),
        F.when(reset, 100.0).otherwise(F.col("p.remaining_percent")).alias("remaining_percent"))


def bin_readings(points: DataFrame, found: DataFrame, b: Bounds, size: int = 1) -> DataFrame:
    """Last observed point in each bin; bins with a reset are left out."""
    def index(ts: Column) -> Column:
        return _bin_of(local_date(ts, b.tz), b, size).alias("bin")

    inside = points.filter(
        F.col("observed") & (F.col("ts") >= F.lit(b.start)) & (F.col("ts") < F.lit(b.end)))
    last = inside.groupBy(ACCOUNT, index(F.col("ts"))).agg(
        F.max_by(F.struct("ts", "remaining_percent"), F.struct("cycle", *ORDER)).alias("r"))
    taken = found.select(ACCOUNT, index(F.col("ts"))).distinct()
    return last.join(taken, [ACCOUNT, "bin"], "left_anti").select(
        ACCOUNT, "bin", *bin_days(F.col("bin"), b, size), "r.ts", "r.remaining_percent")


def quota_cycle(
    tl: DataFrame, events: DataFrame, b: Bounds, rates: dict[str, Rate] = RATE_CARD
) -> DataFrame:
    """Use of the current cycle, and the window's share of it.

    Shares go by credits when every token of the cycle is rated, else by tokens.
    """
    reset_ms = F.col("resets_at") * 1_000
    begin = reset_ms - F.col("window_minutes").cast("long") * 60_000
    through = F.least(reset_ms, F.unix_millis(F.coalesce("event_cutoff_at", "ts")))
    meter = current_meter(tl).select(
        ACCOUNT, F.col("normalized_used_percent").alias("used_percent"),
        F.timestamp_millis(begin).alias("cycle_from"),
        F.timestamp_millis(through).alias("cycle_through"),
    ).filter("cycle_through >= cycle_from")
    shown = (F.col("ts") >= F.lit(b.start)) & (F.col("ts") < F.lit(b.end))
    ends = [meter.agg(F.min("cycle_from")).scalar(), meter.agg(F.max("cycle_through")).scalar()]
    slim = in_range(events, *ends).select(
        ACCOUNT, "ts", F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
        event_credits(rates).alias("c"), shown.alias("shown"))
    inside = slim.join(meter.select(ACCOUNT, "cycle_from", "cycle_through"), ACCOUNT).filter(
        F.col("ts").between(F.col("cycle_from"), F.col("cycle_through")))

    def when(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    every = F.lit(True)
    sums = inside.groupBy(ACCOUNT).agg(
        when(every, F.col("tokens")).alias("cycle_tokens"),
        when(every, F.col("c")).alias("cycle_credits"),
        when(F.col("c").isNotNull(), F.col("tokens")).alias("rated"),
        when(F.col("shown"), F.col("tokens")).alias("displayed_tokens"),
        when(F.col("shown"), F.col("c")).alias("displayed_credits"))
    tokens = F.coalesce("cycle_tokens", F.lit(0))
    by_credits = (tokens > 0) & (F.col("rated") == tokens) & (F.col("cycle_credits") > 0)
    share = F.when(
        by_credits, F.col("displayed_credits") / F.col("cycle_credits") * 100
    ).when(tokens != 0, F.col("displayed_tokens") / tokens * 100)
    return meter.join(sums, ACCOUNT, "left").select(
        ACCOUNT, "used_percent", (100 - F.col("used_percent")).alias("remaining_percent"),
        tokens.alias("cycle_tokens"),
        F.coalesce("displayed_tokens", F.lit(0)).alias("displayed_tokens"),
        share.alias("displayed_share_percent"),
        F.when(F.coalesce(by_credits, F.lit(False)), "credits").otherwise("tokens")
        .alias("share_basis"),
        (F.col("used_percent") * share / 100).alias("estimated_displayed_burn_percent"))
