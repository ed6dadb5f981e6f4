"""The weekly quota meter: choosing one meter and cleaning its timeline.

Readings need: account_id, ts, used_percent, window_minutes, resets_at, limit_key, limit_name,
scope, event_cutoff_at and ``seen``, their place in the source (any orderable struct or number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.numbers import clamp_percent
from meterlake.keys import ACCOUNT, RESET_JITTER_SECONDS, WEEK_MINUTES
from meterlake.operators.first_fit import CHUNK_ROWS, first_fit_windows
from meterlake.operators.scan import Running, even_ranges, running
from meterlake.storage import Scratch, materialize

ORDER = ["ts", "resets_at", "seen"]
_WEEK_MS = WEEK_MINUTES * 60_000


def weekly_observations(quota: DataFrame) -> DataFrame:
    """Readings of a weekly window, with the used share held to 0..100."""
    used = F.col("used_percent")
    return quota.filter(
        (F.col("window_minutes") == WEEK_MINUTES) & F.col("ts").isNotNull()
        & (F.col("resets_at") > 0) & used.isNotNull() & ~F.isnan(used)
        & (F.abs(used) < float("inf"))
    ).withColumn("used_percent", clamp_percent(used))


def select_meter(weekly: DataFrame) -> DataFrame:
    """Keep one meter per account.

    Account-scoped readings if any; else, when limits carry keys, the largest key group among those
    never named (or among all); else unnamed readings (or all).
    """
    named = F.coalesce(F.col("limit_name") != "", F.lit(False))
    scoped = F.coalesce(F.col("scope") == "account", F.lit(False))
    key = F.coalesce("limit_key", F.lit("anonymous"))
    groups = weekly.groupBy(ACCOUNT, key.alias("meter_key")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(named).alias("named"),
        F.bool_or(scoped).alias("scoped"), F.bool_or(~named).alias("some_unnamed"),
        F.bool_or(F.coalesce(F.col("limit_key") != "", F.lit(False))).alias("keyed"),
        F.min(F.struct("seen")).alias("first_seen"),
    )
    best = groups.groupBy(ACCOUNT).agg(
        F.min_by("meter_key", F.struct("named", -F.col("n"), F.col("first_seen"))).alias("best"),
        F.bool_or("scoped").alias("any_scoped"), F.bool_or("keyed").alias("any_keyed"),
        F.bool_or("some_unnamed").alias("any_unnamed"),
    )
    keep = (
        F.when(F.col("any_scoped"), scoped)
        .when(F.col("any_keyed"), key == F.col("best"))
        .when(F.col("any_unnamed"), ~named)
        .otherwise(F.lit(True))
    )
    return weekly.join(best, ACCOUNT).filter(keep).select(*weekly.columns)


def assign_epochs(obs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Tell quota windows apart by their reset time.

    A reading joins the first window within five minutes of its latest reset time, else opens one.
    Reset times more than five minutes from any other can never share a window, so gaps in the
    sorted distinct values split the work exactly; a gap-free cluster no wider than five minutes is
    one window. Only wider clusters need the sequential rule, which is spread over chunks of
    ``chunk_rows`` readings (see ``first_fit``).
    """
    # Reset times are whole seconds, so even a busy account has few distinct ones.
    by_reset = Window.partitionBy(ACCOUNT).orderBy("resets_at")
    gap = F.col("resets_at") - F.lag("resets_at").over(by_reset)
    opens = F.when(F.coalesce(gap > RESET_JITTER_SECONDS, F.lit(True)), F.col("resets_at"))
    clusters = (
        obs.select(ACCOUNT, "resets_at").distinct()
        .withColumn("opens", opens)
        # A cluster is named by its smallest reset time.
        .withColumn("cluster", F.last("opens", ignorenulls=True).over(
            by_reset.rowsBetween(Window.unboundedPreceding, 0)))
    )
    top = F.max("resets_at").over(Window.partitionBy(ACCOUNT, "cluster"))
    named = materialize(clusters.select(
        ACCOUNT, "resets_at", "cluster",
        (top - F.col("cluster") > RESET_JITTER_SECONDS).alias("wide")), "clusters")
    placed = obs.join(named, [ACCOUNT, "resets_at"])
    narrow = placed.filter(~F.col("wide")).withColumn("part", F.lit(0))
    if named.filter("wide").isEmpty():
        return narrow.drop("wide")
    wide = first_fit_windows(
        placed.filter("wide"), [ACCOUNT, "cluster"], "resets_at", ORDER, RESET_JITTER_SECONDS,
        Scratch(obs.sparkSession, "windows"), chunk_rows)
    return narrow.unionByName(wide).drop("wide")


def epoch_table(placed: DataFrame) -> DataFrame:
    """One row per window: readings, first and last time, latest reset time."""
    return placed.groupBy(ACCOUNT, "cluster", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("resets_at").alias("epoch_resets_at"),
        F.min(F.struct(*ORDER)).alias("first_reading"))


def drop_transient(epochs: DataFrame) -> DataFrame:
    """Drop windows of one or two readings lying strictly inside a window with more readings.

    The latest end among windows that began earlier settles it, so no pairs are formed.
    """
    earlier = Window.partitionBy(ACCOUNT).orderBy(F.unix_millis("first_ts")).rangeBetween(
        Window.unboundedPreceding, -1)

    def reach(count: int) -> Column:
        return F.max(F.when(F.col("n") > count, F.unix_millis("last_ts"))).over(earlier)

    marked = epochs.withColumn("reach1", reach(1)).withColumn("reach2", reach(2))
    end = F.unix_millis("last_ts")
    inside = ((F.col("n") == 1) & (F.col("reach1") > end)) | (
        (F.col("n") == 2) & (F.col("reach2") > end))
    return marked.filter(~F.coalesce(inside, F.lit(False))).drop("reach1", "reach2")


def cycles(epochs: DataFrame) -> DataFrame:
    """Number the kept windows and say how each began.

    A window stops counting once the next one reports; one that never counted is passed over when
    the kind of the next beginning is decided, but keeps its number.
    """
    w = Window.partitionBy(ACCOUNT).orderBy("first_ts", "epoch_resets_at", "cluster", "part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = drop_transient(epochs).select(
        "*", (F.row_number().over(w) - 1).alias("cycle"),
        F.lead("first_ts").over(w).alias("next_first_ts"),
    ).withColumn("emits", F.coalesce(F.col("first_ts") < F.col("next_first_ts"), F.lit(True)))
    told = numbered.withColumn(
        "prev_resets_at",
        F.last(F.when(F.col("emits"), F.col("epoch_resets_at")), ignorenulls=True).over(before))
    first_s = F.unix_millis("first_ts") / 1_000
    kind = (
        F.when(F.col("prev_resets_at").isNull(), "start")
        .when(F.col("prev_resets_at") <= first_s + RESET_JITTER_SECONDS, "weekly-expiry")
        .otherwise("restart")
    )
    return told.filter("emits").select(
        ACCOUNT, "cluster", "part", "cycle", "n", "first_ts", "last_ts", "next_first_ts",
        "epoch_resets_at", "first_reading", kind.alias("reset_kind"),
        F.timestamp_millis(F.col("epoch_resets_at") * 1_000 - F.lit(_WEEK_MS))
        .alias("cycle_start_ts"))


def normalize_timeline(obs: DataFrame) -> DataFrame:
    """Clean timeline of one meter per account: cycles, resets and never-falling use.

    Readings at or after the next cycle's first are stale and go; a dip inside a cycle is lifted to
    the highest reading so far.
    """
    # Even ranges of an account's time, so that its busiest hour is no single task.
    placed = even_ranges(assign_epochs(obs), [ACCOUNT], ORDER, "placed")
    table = cycles(epoch_table(placed))
    live = placed.join(
        table.select(ACCOUNT, "cluster", "part", "cycle", "next_first_ts", "first_reading",
                     "reset_kind", "cycle_start_ts"),
        [ACCOUNT, "cluster", "part"],
    ).filter(F.col("next_first_ts").isNull() | (F.col("ts") < F.col("next_first_ts")))
    shaped = live.select(
        *obs.columns, "cycle", "reset_kind", "cycle_start_ts",
        ((F.struct(*ORDER) == F.col("first_reading")) & (F.col("reset_kind") != "start"))
        .alias("reset"),
        "_chunk",
    )
    lifted = running(
        shaped, [ACCOUNT, "cycle"], "_chunk", ORDER,
        {
            "normalized_used_percent": Running("max", F.col("used_percent")),
            "used_before": Running("max", F.col("used_percent"), before=True),
        },
    )
    # Many tables are read off the timeline, so it is stored.
    return materialize(lifted.drop("_chunk"), "timeline")


def timeline(quota: DataFrame) -> DataFrame:
    """Clean weekly timeline from raw quota readings."""
    return normalize_timeline(select_meter(weekly_observations(quota)))


def current_meter(tl: DataFrame) -> DataFrame:
    """Newest reading of each account's meter."""
    fields = [c for c in tl.columns if c != ACCOUNT]
    newest = tl.groupBy(ACCOUNT).agg(
        F.max_by(F.struct(*fields), F.struct("cycle", *ORDER)).alias("r"))
    return newest.select(ACCOUNT, "r.*")
