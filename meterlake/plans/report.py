"""Report tables over a ledger: trend, pace, facts and column choice."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.models import RATE_CARD, RATE_CARD_AS_OF, Rate
from meterlake.keys import ACCOUNT
from meterlake.operators import bins as B
from meterlake.operators import burn as burning
from meterlake.operators import display
from meterlake.operators.meter import ORDER, normalize_timeline, select_meter, weekly_observations
from meterlake.operators.projects import rate_summary
from meterlake.operators.windows import Bounds, in_window
from meterlake.storage import materialize


@dataclass(frozen=True)
class UsageTrend:
    """The trend of a window. Accounts without meter readings appear in ``models`` only.

    ``spans`` are those of the cycles that the window shows, from their beginnings.
    """

    bounds: Bounds
    observations: DataFrame
    timeline: DataFrame
    spans: DataFrame
    points: DataFrame
    resets: DataFrame
    intervals: DataFrame
    models: DataFrame
    summary: DataFrame


def usage_trend(
    events: DataFrame, quota: DataFrame, b: Bounds, rates: dict[str, Rate] = RATE_CARD,
    rate_card_as_of: str = RATE_CARD_AS_OF,
) -> UsageTrend:
    """Tie the window's meter drops to models and days."""
    obs = select_meter(weekly_observations(quota))
    tl = normalize_timeline(obs)
    spans = burning.burn(tl, events, b, rates, shown_only=True)
    every = materialize(burning.meter_points(tl, spans, b), "points")
    shown = display.display_points(every, b)
    inside = F.col("ts") >= F.lit(b.start)
    counts = every.groupBy(ACCOUNT).agg(
        F.count_if(inside).alias("sample_count"), F.max("ts").alias("observed_through"))
    method = burning.allocation_method(spans, b)
    summary = counts.join(method, ACCOUNT, "left").select(
        ACCOUNT, F.lit(True).alias("available"), "sample_count", "observed_through",
        F.coalesce("allocation_method", F.lit("unavailable")).alias("allocation_method"),
        F.lit(rate_card_as_of).alias("rate_card_as_of"))
    return UsageTrend(
        b, obs, tl, spans, shown, display.resets(tl, b), burning.clip(spans, b),
        burning.model_stats(in_window(events, b), spans, b, rates), summary)


def _newest(points: DataFrame) -> DataFrame:
    return points.groupBy(ACCOUNT).agg(
        F.max_by("remaining_percent", F.struct("ts", "cycle", *ORDER[1:]))
        .alias("remaining_percent"),
        F.max("ts").alias("meter_last_read_at"), F.count(F.lit(1)).alias("n_points"))


def _next_reset(observations: DataFrame, b: Bounds) -> DataFrame:
    return observations.filter(F.col("ts") < F.lit(b.end)).groupBy(ACCOUNT).agg(
        F.max_by("resets_at", F.struct(*ORDER)).alias("latest_resets_at"))


def meter_usable(trend: UsageTrend, bins: DataFrame) -> DataFrame:
    """Per account: points burned in the window, newest meter reading, and whether they serve."""
    burned = burning.burn_totals(bins)
    newest = _newest(trend.points)
    return newest.join(burned, ACCOUNT, "left").select(
        ACCOUNT, "remaining_percent", "meter_last_read_at",
        F.coalesce("points_burned", F.lit(0.0)).alias("points_burned"),
        (F.col("n_points") > 1).alias("has_line"),
        F.coalesce(F.col("points_burned") > 0, F.lit(False)).alias("usable"))


def trend_columns(trend: UsageTrend, events: DataFrame, size: int = 1,
                  drain: bool = False) -> DataFrame:
    """Columns to draw: meter points where asked for and usable, else tokens."""
    b = trend.bounds
    tokens = B.token_bins(events, b, size).select(
        ACCOUNT, "bin", "start_day", "end_day", "model", F.col("tokens").cast("double")
        .alias("value"), F.lit("tokens").alias("unit"))
    if not drain:
        return tokens
    points = burning.burn_bins(trend.spans, b, size).select(
        ACCOUNT, "bin", "start_day", "end_day", "model", F.col("points").alias("value"),
        F.lit("meter points").alias("unit"))
    drained = points.select(ACCOUNT).distinct()
    return points.unionByName(tokens.join(drained, ACCOUNT, "left_anti"))


def pace(
    trend: UsageTrend, events: DataFrame, generated_at: datetime, size: int = 1
) -> DataFrame:
    """Daily average, tokens per meter point, runway and how it meets the next reset."""
    b = trend.bounds
    used = in_window(events, b).groupBy(ACCOUNT).agg(
        F.sum(F.greatest(F.lit(0).cast("long"), F.coalesce("total_tokens", F.lit(0))))
        .alias("total_tokens"))
    meter = meter_usable(trend, burning.burn_bins(trend.spans, b, size))
    t = used.join(meter, ACCOUNT, "left").join(
        _next_reset(trend.observations, b), ACCOUNT, "left")
    total = F.col("total_tokens")
    ok = F.coalesce(F.col("has_line") & F.col("usable") & (total > 0), F.lit(False))
    daily = total / F.lit(max(1, b.days))
    per_point = F.when(ok, total / F.col("points_burned"))
    burn_per_day = F.when(ok, daily / per_point)
    runway = F.when(burn_per_day > 0, F.col("remaining_percent") / burn_per_day)
    to_reset = F.when(ok, (
        F.col("latest_resets_at") * 1_000 - F.unix_millis(F.lit(generated_at).cast("timestamp"))
    ) / 86_400_000)
    gap = F.when(runway.isNotNull() & (to_reset > 0), runway - to_reset)
    note = (
        F.when(~ok, "no usable meter drain").when(gap.isNull(), F.lit(None).cast("string"))
        .when(F.abs(gap) <= 1.5, "lands near the reset")
        .when(gap > 0, "leaves headroom").otherwise("runs out before the reset")
    )
    return t.select(
        ACCOUNT, "total_tokens", daily.alias("daily_average"),
        per_point.alias("tokens_per_point"), burn_per_day.alias("burn_per_day"),
        runway.alias("runway_days"), to_reset.alias("days_to_reset"),
        gap.alias("headroom_days"), note.alias("note"))


def report_facts(
    trend: UsageTrend, events: DataFrame, generated_at: datetime, size: int = 1,
    rates: dict[str, Rate] = RATE_CARD,
) -> DataFrame:
    """Points burned, estimated cost, resets and how fresh the figures are."""
    b = trend.bounds
    cost = rate_summary(in_window(events, b), rates)
    meter = meter_usable(trend, burning.burn_bins(trend.spans, b, size))
    counts = display.reset_counts(trend.resets)
    last_reset = trend.resets.groupBy(ACCOUNT).agg(
        F.max_by("ts", "observed_at").alias("last_reset_at"))
    out = cost
    for part in (meter, counts, last_reset, _next_reset(trend.observations, b)):
        out = out.join(part, ACCOUNT, "left")
    usable = F.coalesce("usable", F.lit(False))
    return out.select(
        ACCOUNT,
        F.when(usable, F.col("points_burned")).alias("points_burned"),
        F.when(F.col("credits") > 0, F.col("credits")).alias("estimated_credits"),
        (F.col("priority_credits") > 0).alias("has_priority_credits"),
        F.coalesce("scheduled", F.lit(0)).alias("scheduled_resets"),
        F.coalesce("early", F.lit(0)).alias("early_resets"),
        "last_reset_at", F.timestamp_seconds("latest_resets_at").alias("next_reset_at"),
        F.coalesce("has_line", F.lit(False)).alias("has_meter_line"),
        F.lit(generated_at).cast("timestamp").alias("data_as_of"), "meter_last_read_at")


def series_export(
    bins: DataFrame, points: DataFrame, found: DataFrame, b: Bounds
) -> tuple[DataFrame, DataFrame]:
    """Two plot series: tokens per day for Luna, Sol and the rest, and the meter with its resets.

    A point within a minute of a reset's reading is preceded by a full meter.
    """
    def tokens(cond) -> object:
        return F.coalesce(F.sum(F.when(cond, F.col("tokens"))), F.lit(0))

    model = F.col("model")
    day = bins.groupBy(ACCOUNT, "start_day").agg(
        tokens(model == "Luna").alias("Luna"), tokens(model == "Sol").alias("Sol"),
        tokens(~model.isin("Luna", "Sol")).alias("Other"))
    columns = day.unpivot([ACCOUNT, "start_day"], ["Luna", "Sol", "Other"], "model", "tokens")
    bars = columns.select(
        ACCOUNT, F.concat_ws(" ", F.date_format("start_day", "MM-dd"), "model").alias("day_model"),
        F.expr("format_number(tokens / 1e9D, '0.000')").alias("tokens_billion"))

    inside = points.filter(F.col("ts") >= F.lit(b.start))
    ms = F.unix_millis("ts")
    x = F.lit(1.0) + (ms - F.lit(b.start_ms)) / F.lit(float(b.end_ms - b.start_ms)) * 6
    minute = F.floor(ms / 60_000)
    # A reset is looked up by the minute it was seen in and the two beside it.
    marks = found.select(
        ACCOUNT, F.unix_millis("observed_at").alias("seen_ms"),
        F.explode(F.sequence(F.floor(F.unix_millis("observed_at") / 60_000) - 1,
                             F.floor(F.unix_millis("observed_at") / 60_000) + 1)).alias("minute"))
    near = inside.select(ACCOUNT, "ts", minute.alias("minute")).distinct().join(
        marks, [ACCOUNT, "minute"]
    ).filter(F.abs(F.col("seen_ms") - ms) < 60_000).select(ACCOUNT, "ts").distinct().withColumn(
        "full", F.lit(True))
    flagged = inside.join(near, [ACCOUNT, "ts"], "left")
    rows = F.when(F.col("full"), F.array(F.lit(100.0), F.col("remaining_percent"))).otherwise(
        F.array("remaining_percent"))
    series = flagged.select(
        ACCOUNT, "ts", "cycle", "resets_at", x.alias("x"),
        F.posexplode(rows).alias("step", "remaining"))
    return bars, series


def write_series(df: DataFrame, path: str) -> None:
    """Write a series as tab-separated text."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


__all__ = [
    "UsageTrend", "meter_usable", "pace", "report_facts", "series_export",
    "trend_columns", "usage_trend", "write_series",
]
