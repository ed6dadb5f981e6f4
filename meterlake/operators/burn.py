"""What drained the meter: drops of the weekly meter tied to models and calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.models import (
    RATE_CARD,
    TREND_FAMILIES,
    Rate,
    event_credits,
    family_order,
    trend_family,
)
from meterlake.functions.numbers import local_date, non_negative, zoned_midnight
from meterlake.keys import ACCOUNT, LONG_GAP_MS
from meterlake.operators.meter import ORDER
from meterlake.operators.scan import Running, running, time_chunk
from meterlake.operators.windows import Bounds, in_range
from meterlake.storage import materialize

UNATTRIBUTED = "Unattributed"
INTERVAL = [ACCOUNT, "cycle", "used_percent", "start_ts", "end_ts", "points"]


def burn_steps(tl: DataFrame, b: Bounds) -> DataFrame:
    """Rise of the used share at each reading before the window's end."""
    before = F.coalesce("used_before", F.lit(0.0))
    return tl.filter(F.col("ts") < F.lit(b.end)).withColumn(
        "points", F.greatest(F.lit(0.0), F.col("normalized_used_percent") - before))


def burn_intervals(tl: DataFrame, b: Bounds) -> DataFrame:
    """Spans over which the meter rose: from the rise before to the reading that shows it.

    A cycle's first span starts at the cycle's own start, but never before the last reading of the
    cycle before it nor after the cycle's first reading.
    """
    steps = burn_steps(tl, b)
    w = Window.partitionBy(ACCOUNT).orderBy("cycle")
    start = F.col("cycle_start_ts")
    opened = steps.groupBy(ACCOUNT, "cycle").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.first("cycle_start_ts").alias("cycle_start_ts"),
    ).select(ACCOUNT, "cycle", F.least(
        F.col("first_ts"), F.greatest(start, F.coalesce(F.lag("last_ts").over(w), start))
    ).alias("opened_ts"))
    rises = steps.filter("points > 0").select(
        ACCOUNT, "cycle", *ORDER, "points",
        F.col("normalized_used_percent").alias("used_percent"),
        time_chunk(F.col("ts")).alias("_chunk"))
    chained = running(rises, [ACCOUNT, "cycle"], "_chunk", ORDER,
                      {"prev_ts": Running("last", F.col("ts"), before=True)})
    return chained.join(opened, [ACCOUNT, "cycle"]).select(
        ACCOUNT, "cycle", "used_percent",
        F.coalesce("prev_ts", "opened_ts").alias("start_ts"), F.col("ts").alias("end_ts"), "points",
    ).withColumn("spans_long_gap", F.unix_millis("end_ts") - F.unix_millis("start_ts")
                 > LONG_GAP_MS)


def _shown_cycles(tl: DataFrame, b: Bounds) -> DataFrame:
    """Cycles with a reading in the window, and the one whose last reading is carried to its start."""
    cycles = tl.filter(F.col("ts") < F.lit(b.end)).groupBy(ACCOUNT, "cycle").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    early = F.when(F.col("first_ts") <= F.lit(b.start), F.col("cycle"))
    carried = F.max(early).over(Window.partitionBy(ACCOUNT))
    return cycles.withColumn("carried", carried).filter(
        (F.col("last_ts") >= F.lit(b.start)) | (F.col("cycle") == F.col("carried"))
    ).select(ACCOUNT, "cycle")


def _weighable(
    events: DataFrame, intervals: DataFrame, b: Bounds, rates: dict[str, Rate]
) -> DataFrame:
    """The few event columns that attribution needs, from the earliest span's start on."""
    low = intervals.agg(F.min("start_ts")).scalar()
    return in_range(events, low, F.lit(b.end)).select(
        ACCOUNT, "ts", trend_family(F.col("model")).alias("family"),
        local_date(F.col("ts"), b.tz).alias("day"),
        event_credits(rates).alias("credits"),
        non_negative(F.col("total_tokens")).alias("tokens"),
    )


def place_events(intervals: DataFrame, events: DataFrame, at: str = "ts") -> DataFrame:
    """Ends of spans and events in one stored table, cut into even ranges of (account, time).

    A range is a chunk of the running pass, so a busy hour or account is no single task. The table
    is stored because both passes over it must see the same ranges.
    """
    span = F.struct("cycle", "used_percent", "start_ts", "end_ts", "points")
    ends = intervals.select(
        ACCOUNT, F.col("end_ts").alias("_at"), F.lit(1).alias("_span"),
        F.col("start_ts").alias("_start"), span.alias("_here"))
    points = events.withColumnRenamed(at, "_at").withColumn("_span", F.lit(0))
    both = ends.unionByName(points, allowMissingColumns=True)
    return materialize(both.repartitionByRange(ACCOUNT, "_at").withColumn(
        "_chunk", F.spark_partition_id()), "placed")


def assign_events(intervals: DataFrame, events: DataFrame, at: str = "ts") -> DataFrame:
    """Pair each event with the span (start, end] holding it; spans of an account are disjoint.

    The span holding an event is the first one ending at or after it, so one pass from late to
    early settles all events without comparing events with spans. Spans come back as rows of their
    own with null event columns, so that spans without events are kept.
    """
    # Of spans ending together only the earliest-starting one has room for events, so it must be
    # the last to pass.
    found = running(
        place_events(intervals, events, at), [ACCOUNT], "_chunk", ["_at", "_span", "_start"],
        {"iv": Running("last", F.col("_here"))}, descending=True)
    inside = F.col("iv").isNotNull() & (F.col("_at") > F.col("iv.start_ts"))
    mine = F.when(F.col("_span") == 1, F.col("_here")).otherwise(F.col("iv"))
    return found.filter((F.col("_span") == 1) | inside).select(
        ACCOUNT, mine.alias("iv"), (F.col("_span") == 1).alias("is_span"),
        F.col("_at").alias(at), *[c for c in events.columns if c not in (ACCOUNT, at)])


def burn_cells(
    tl: DataFrame, events: DataFrame, b: Bounds, rates: dict[str, Rate] = RATE_CARD,
    shown_only: bool = False,
) -> DataFrame:
    """Event sums per span, family and local day; a span's own row has a null family.

    With ``shown_only``, only cycles that the window shows are told of, so events before the first
    of them are not read.
    """
    found = burn_intervals(tl, b)
    if shown_only:
        found = found.join(_shown_cycles(tl, b), [ACCOUNT, "cycle"], "left_semi")
    intervals = materialize(found, "intervals")
    pairs = assign_events(intervals, _weighable(events, intervals, b, rates))
    rated = F.coalesce(F.col("credits") > 0, F.lit(False))
    return pairs.groupBy(
        ACCOUNT, *[F.col(f"iv.{c}").alias(c) for c in INTERVAL[1:]], "family", "day"
    ).agg(
        F.coalesce(F.sum(F.when(rated, F.col("credits"))), F.lit(0.0)).alias("rated_credits"),
        F.coalesce(F.sum(F.when(rated, F.col("tokens"))), F.lit(0)).alias("rated_tokens"),
        F.coalesce(F.sum(F.when(~rated, F.col("tokens"))), F.lit(0)).alias("unrated_tokens"),
    )


def _duration_shares(tz: str) -> Column:
    """Share of the span on each local day it touches."""
    start, end = F.col("start_ts"), F.col("end_ts")
    first, last = local_date(start, tz), local_date(F.timestamp_millis(F.unix_millis(end) - 1), tz)
    length = F.unix_millis(end) - F.unix_millis(start)

    def share(day: Column) -> Column:
        lo = F.greatest(F.unix_millis(start), F.unix_millis(zoned_midnight(day, tz)))
        hi = F.least(F.unix_millis(end), F.unix_millis(zoned_midnight(F.date_add(day, 1), tz)))
        return F.struct(day.alias("day"), ((hi - lo) / length).alias("share"))

    spread = F.filter(
        F.transform(F.sequence(first, F.greatest(first, last)), share), lambda s: s["share"] > 0)
    point = F.array(F.struct(local_date(end, tz).alias("day"), F.lit(1.0).alias("share")))
    return F.when(length > 0, spread).otherwise(point)


def allocate(cells: DataFrame, b: Bounds) -> DataFrame:
    """One row per span: points per family, share per local day, and how they were found.

    An event weighs its credits; without credits it weighs its tokens, priced at the span's average
    credits per token when the span has rated events. A span's cells are few: families × days.
    """
    part = F.struct("family", "day", "rated_credits", "rated_tokens", "unrated_tokens")
    spans = cells.groupBy(*INTERVAL).agg(
        F.sum("rated_credits").alias("rc"), F.sum("rated_tokens").alias("rt"),
        F.sum("unrated_tokens").alias("ut"),
        F.collect_list(F.when(F.col("family").isNotNull(), part)).alias("cells"))
    per_token = F.when((F.col("rc") > 0) & (F.col("rt") > 0), F.col("rc") / F.col("rt"))
    unit = F.coalesce(per_token, F.lit(1.0))

    def weight(c: Column) -> Column:
        return c["rated_credits"] + c["unrated_tokens"] * F.col("unit")

    def total(cs: Column, f) -> Column:
        return F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + f(c))

    live = F.filter("cells", lambda c: weight(c) > 0)
    spans = spans.withColumn("unit", unit).withColumn("live", live).withColumn(
        "weight", total(F.col("live"), weight))

    def share_of(name: str, key: Column) -> Column:
        mine = F.filter("live", lambda c: c[name] == key)
        return total(mine, weight) / F.col("weight")

    def family(f: Column) -> Column:
        mine = F.filter("live", lambda c: c["family"] == f)
        tokens = total(mine, lambda c: (c["rated_tokens"] + c["unrated_tokens"]).cast("double"))
        return F.struct(
            f.alias("model"), (F.col("points") * share_of("family", f)).alias("points"),
            tokens.cast("long").alias("tokens"))

    def keys(name: str) -> Column:
        return F.array_distinct(F.transform("live", lambda c: c[name]))

    any_weight = F.col("weight") > 0
    nobody = F.array(F.struct(
        F.lit(UNATTRIBUTED).alias("model"), F.col("points").alias("points"),
        F.lit(0).cast("long").alias("tokens")))
    method = (
        F.when(~any_weight, "unattributed")
        .when((F.col("rc") > 0) & (F.col("ut") > 0), "mixed")
        .when(F.col("rc") > 0, "rate-card")
        .otherwise("tokens")
    )
    by_weight = F.transform(keys("day"), lambda d: F.struct(
        d.alias("day"), share_of("day", d).alias("share")))
    return spans.select(
        *INTERVAL,
        (F.unix_millis("end_ts") - F.unix_millis("start_ts") > LONG_GAP_MS)
        .alias("spans_long_gap"),
        method.alias("method"),
        F.when(any_weight, F.transform(keys("family"), family)).otherwise(nobody)
        .alias("contributions"),
        F.when(any_weight, by_weight).otherwise(_duration_shares(b.tz)).alias("day_shares"),
    )


def burn(
    tl: DataFrame, events: DataFrame, b: Bounds, rates: dict[str, Rate] = RATE_CARD,
    shown_only: bool = False,
) -> DataFrame:
    """Attributed spans up to the window's end: of all history, or of the cycles the window shows."""
    return materialize(allocate(burn_cells(tl, events, b, rates, shown_only), b), "spans")


def burn_by_model(spans: DataFrame) -> DataFrame:
    """One row per span and family."""
    return spans.select(*INTERVAL, "method", F.inline("contributions").alias(
        "model", "model_points", "model_tokens"))


def burn_day_shares(spans: DataFrame) -> DataFrame:
    """One row per span and local day."""
    return spans.select(*INTERVAL, F.inline("day_shares").alias("day", "share"))


def clip(spans: DataFrame, b: Bounds) -> DataFrame:
    """Spans ending inside the window; starts are cut to it, day shares stay as they are."""
    return spans.filter(
        (F.col("end_ts") >= F.lit(b.start)) & (F.col("end_ts") < F.lit(b.end))
    ).withColumn("start_ts", F.greatest(F.col("start_ts"), F.lit(b.start)))


def allocation_method(spans: DataFrame, b: Bounds) -> DataFrame:
    """How the window's drops were split, one text per account."""
    def used(name: str) -> Column:
        return F.bool_or(F.col("method") == name).alias(name.replace("-", "_"))

    m = spans.filter(F.col("end_ts") >= F.lit(b.start)).groupBy(ACCOUNT).agg(
        used("mixed"), used("rate-card"), used("tokens"), used("unattributed"))
    base = (
        F.when(F.col("mixed") | (F.col("rate_card") & F.col("tokens")),
               "mixed rate-card and token weights")
        .when(F.col("rate_card"), "rate-card weights")
        .when(F.col("tokens"), "token weights")
        .when(F.col("unattributed"), "unattributed burn")
    )
    gaps = F.col("unattributed") & (base != "unattributed burn")
    text = F.when(gaps, F.concat(base, F.lit(" with unattributed gaps"))).otherwise(base)
    return m.select(ACCOUNT, text.alias("allocation_method"))


def meter_points(tl: DataFrame, spans: DataFrame, b: Bounds) -> DataFrame:
    """Readings before the window's end with each family's share of the cycle's use so far."""
    steps = burn_steps(tl, b)
    gains = spans.select(ACCOUNT, "cycle", "used_percent", F.map_from_entries(
        F.transform("contributions", lambda c: F.struct(c["model"], c["points"]))
    ).alias("gain"))
    joined = steps.select(
        ACCOUNT, "cycle", *ORDER, "points",
        F.col("normalized_used_percent").alias("used_percent"),
        time_chunk(F.col("ts")).alias("_chunk"),
        F.when(F.col("points") > 0, F.col("normalized_used_percent")).alias("_rise"),
    ).join(
        gains.withColumnRenamed("used_percent", "_rise"), [ACCOUNT, "cycle", "_rise"], "left")
    cum = {
        f"_f{i}": Running("sum", F.try_element_at("gain", F.lit(f)))
        for i, f in enumerate(TREND_FAMILIES)
    }
    summed = running(joined, [ACCOUNT, "cycle"], "_chunk", ORDER, cum)
    pairs = F.array(*[
        F.struct(F.lit(f).alias("model"), F.col(f"_f{i}").alias("points"))
        for i, f in enumerate(TREND_FAMILIES)
    ])
    return summed.select(
        ACCOUNT, "cycle", *ORDER, "used_percent",
        (F.lit(100.0) - F.col("used_percent")).alias("remaining_percent"),
        F.map_from_entries(F.filter(pairs, lambda p: p["points"].isNotNull())).alias("allocations"),
    )


def burn_bins(spans: DataFrame, b: Bounds, size: int = 1) -> DataFrame:
    """Points per bin and family: a span's family points times its day shares.

    Days outside the window are dropped. A bin is approximate if a long span reaches into it.
    """
    inside = clip(spans, b)
    days = inside.select(
        ACCOUNT, "contributions", "spans_long_gap", F.inline("day_shares").alias("day", "share")
    ).filter(F.col("day").between(F.lit(b.first_day), F.lit(b.last_day)))
    cells = days.select(
        ACCOUNT, _bin_of(F.col("day"), b, size).alias("bin"), "spans_long_gap", "share",
        F.inline("contributions").alias("model", "model_points", "model_tokens"))
    # A bin's flag covers all its families, so it is found per bin beside the sums.
    per = cells.groupBy(ACCOUNT, "bin", "model").agg(
        F.sum(F.col("model_points") * F.col("share")).alias("points"),
        F.bool_or("spans_long_gap").alias("long_gap"))
    flag = F.max("long_gap").over(Window.partitionBy(ACCOUNT, "bin"))
    return per.withColumn("approximate", flag).filter("points > 0").select(
        ACCOUNT, "bin", *bin_days(F.col("bin"), b, size), "model", "points", "approximate")


def _bin_of(day: Column, b: Bounds, size: int) -> Column:
    return F.floor(F.datediff(day, F.lit(b.first_day)) / F.lit(size)).cast("int")


def bin_days(index: Column, b: Bounds, size: int) -> list[Column]:
    """First day of a bin and the day after its last one; the last bin may be short."""
    first = F.lit(b.first_day)
    until = F.least(F.lit(b.days), (index + 1) * F.lit(size)).cast("int")
    return [
        F.date_add(first, (index * F.lit(size)).cast("int")).alias("start_day"),
        F.date_add(first, until).alias("end_day"),
    ]


def burn_totals(bins: DataFrame) -> DataFrame:
    """Points burned in the window per account."""
    return bins.groupBy(ACCOUNT).agg(F.sum("points").alias("points_burned"))



def model_stats(
    displayed: DataFrame, spans: DataFrame, b: Bounds, rates: dict[str, Rate] = RATE_CARD
) -> DataFrame:
    """Usage and burn per trend family; families with burn but no displayed usage are kept."""
    slim = displayed.select(
        ACCOUNT, trend_family(F.col("model")).alias("model"),
        F.lower(F.coalesce(F.nullif("effort", F.lit("")), F.lit("unknown"))).alias("effort"),
        non_negative(F.col("total_tokens")).alias("tokens"), event_credits(rates).alias("c"),
        F.struct("ts", "seen").alias("at"))
    per_effort = slim.groupBy(ACCOUNT, "model", "effort").agg(
        F.sum("tokens").alias("tokens"), F.sum("c").alias("credits"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tokens")).otherwise(0)).alias("rated_tokens"),
        F.min("at").alias("first_event"))
    used = per_effort.groupBy(ACCOUNT, "model").agg(
        F.sum("tokens").alias("tokens"),
        F.coalesce(F.sum("credits"), F.lit(0.0)).alias("credits"),
        F.sum("rated_tokens").alias("rated_tokens"),
        F.min_by(F.struct("effort", "tokens"), F.struct(-F.col("tokens"), F.col("first_event")))
        .alias("top"))
    burned = clip(spans, b).select(ACCOUNT, F.inline("contributions").alias(
        "model", "model_points", "model_tokens")).groupBy(ACCOUNT, "model").agg(
        F.sum("model_points").alias("burn_points"),
        F.sum("model_tokens").alias("attributed_tokens"))
    t = F.coalesce("tokens", F.lit(0))
    points, attributed = F.col("burn_points"), F.col("attributed_tokens")
    return used.join(burned, [ACCOUNT, "model"], "full_outer").select(
        ACCOUNT, "model", t.alias("tokens"), F.coalesce("credits", F.lit(0.0)).alias("credits"),
        F.coalesce("rated_tokens", F.lit(0)).alias("rated_tokens"),
        F.coalesce(attributed, F.lit(0)).alias("attributed_tokens"),
        F.coalesce(points, F.lit(0.0)).alias("burn_points"),
        F.coalesce("top.effort", F.lit("unknown")).alias("dominant_effort"),
        F.when(t > 0, F.col("top.tokens") / t).otherwise(0.0).alias("dominant_effort_share"),
        F.when((points > 0) & (attributed > 0), attributed / points)
        .alias("tokens_per_burn_point"),
        F.when(t > 0, F.col("rated_tokens") / t * 100).alias("rated_percent"),
        family_order(F.col("model")).alias("position"),
    )
