"""Winners among copies of the same record across files.

Every winner comes from an aggregate with an explicit order key, so it is independent of task
order, and copies are reduced on the map side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.numbers import hash_id
from meterlake.keys import ACCOUNT

SEEN_TYPE = "struct<file:string,block:long,ord:long,part:int>"


def scan_position(part: Column | None = None) -> Column:
    """Place of a record in scan order: file path, then line."""
    return F.struct("file", "block", "ord", (part if part is not None else F.lit(0)).alias("part"))


def turn_origins(candidates: DataFrame) -> DataFrame:
    """The task start that began each turn: smallest delay, then first in scan order."""
    return (
        candidates.groupBy(ACCOUNT, "turn")
        .agg(F.min_by(
            F.struct("thread_id", "at", "delta_ms", "model", "effort", "cwd", "git",
                     "raw_source", "service_tier"),
            F.struct("delta_ms", scan_position())).alias("origin"))
    )


def _numbers(u: Column) -> Column:
    return F.concat(
        F.lit("["), F.concat_ws(",", *[u[x].cast("string") for x in "icwort"]), F.lit("]"))


def call_key() -> Column:
    """JSON text of (turn or `legacy`, cumulative counts, last counts, context window)."""
    opened = F.to_json(F.array(F.coalesce("turn", F.lit("legacy"))))
    return F.concat(
        F.substring(opened, F.lit(1), F.length(opened) - 1), F.lit(","),
        _numbers(F.col("total")), F.lit(","), _numbers(F.col("last")), F.lit(","),
        F.col("context_window").cast("string"), F.lit("]"),
    )


def call_id(key: Column) -> Column:
    return F.concat(F.lit("evt-"), hash_id(key))


def dedupe_calls(tokens: DataFrame) -> DataFrame:
    """One row per model call. The first likely original wins, else the first copy.

    ``seen`` stays the first copy's position; ``copies`` counts all of them.
    """
    occurrence = F.struct(
        "ts", "thread_id", "original_likely", "model", "effort", "cwd", "git", "raw_source",
        "service_tier", "last")
    return (
        tokens.withColumn("key", call_key())
        .groupBy(ACCOUNT, "turn", "key")
        .agg(
            F.min_by(occurrence, F.struct(~F.col("original_likely"), scan_position())).alias("o"),
            F.min(scan_position()).alias("seen"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(
            ACCOUNT, "turn", "key", "o.*", "seen", "copies",
            call_id(F.col("key")).alias("id"),
            F.when(F.col("turn").isNotNull(), "turn-exact").otherwise("legacy-heuristic")
            .alias("dedupe_quality"),
        )
    )


def tool_key() -> Column:
    """A tool call's own id, else its number within (turn, type, name)."""
    return F.when(
        F.col("stable_id").isNotNull(), F.concat(F.lit("id|"), F.col("stable_id"))
    ).otherwise(F.concat_ws("|", F.lit("ordinal"), "turn", "type", "name", "ordinal"))


def dedupe_tool_calls(calls: DataFrame) -> DataFrame:
    """One row per tool call."""
    return (
        calls.withColumn("key", tool_key())
        .groupBy(ACCOUNT, "key")
        .agg(F.min_by(F.struct("turn", "thread_id", "original_likely", "type", "name"),
                      F.struct(~F.col("original_likely"), scan_position())).alias("o"))
        .select(ACCOUNT, "key", "o.*")
    )


def _plain_number(c: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def dedupe_quota(readings: DataFrame) -> DataFrame:
    """One row per (limit, window, reset, used): likely originals, then earliest, then first.

    Their place is by time and then by position, whatever the order of the files.
    """
    position = scan_position(F.col("part"))
    key = F.concat_ws("|", "limit_key", "window_minutes", "resets_at",
                      _plain_number(F.col("used_percent")))
    return (
        readings.groupBy(ACCOUNT, "limit_key", "window_minutes", "resets_at", "used_percent")
        .agg(
            F.min_by(F.struct("ts", "plan_type", "limit_name", "original_likely"),
                     F.struct(~F.col("original_likely"), F.col("ts"), position)).alias("o"),
            F.min(position).alias("seen"),
        )
        .select(
            ACCOUNT, F.concat(F.lit("quota-"), hash_id(key)).alias("id"), "o.ts", "used_percent",
            "window_minutes", "resets_at", "o.plan_type", "limit_key", "o.limit_name",
            F.lit("log").alias("source"),
            F.lit(None).cast("string").alias("scope"),
            F.lit(None).cast("timestamp").alias("event_cutoff_at"),
            F.struct(F.unix_micros("o.ts").alias("at"), "seen.*").alias("seen"),
        )
    )


def thread_parents(edges: DataFrame, metas: DataFrame) -> DataFrame:
    """Parent of each thread: a session record beats a spawn edge; the last one wins.

    Of a thread's edges, the last is that of the greatest ``position``, then of the greatest parent.
    """
    from_edges = edges.select(
        ACCOUNT, F.col("child_thread_id").alias("thread_id"), "parent_thread_id",
        F.lit(0).alias("rank"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block"),
        F.coalesce("position", F.lit(-1).cast("long")).alias("ord"),
    )
    from_metas = metas.select(
        ACCOUNT, "thread_id", "parent_thread_id", F.lit(1).alias("rank"), "file", "block", "ord")
    return from_edges.unionByName(from_metas).groupBy(ACCOUNT, "thread_id").agg(
        F.max_by("parent_thread_id", F.struct("rank", scan_position(), "parent_thread_id"))
        .alias("parent_thread_id"))
