"""Per-file context: what model, turn and settings each log record was written under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.numbers import epoch_ms, epoch_to_ts, hash_id, safe_ts
from meterlake.keys import ACCOUNT, ORIGINAL_MAX_DELTA_MS
from meterlake.operators.scan import Running, closing, running
from meterlake.sources.rollouts import thread_id_of_file

POSITION = ["block", "ord"]
_NEVER = 9_223_372_036_854_775_807


def _position() -> Column:
    return F.struct(*POSITION)


def _prepared(records: DataFrame) -> DataFrame:
    """Records with what each of them sets."""
    kind = F.col("kind")
    own_meta = (kind == "meta") & (F.col("meta.id") == thread_id_of_file(F.col("file")))
    is_start = kind == "start"
    outer = safe_ts(F.col("at"))
    delta = F.when(
        outer.isNotNull(), F.abs(F.unix_millis(outer) - epoch_ms(F.col("started_at")))
    ).otherwise(F.lit(_NEVER))
    return records.select(
        "*",
        F.when(own_meta, F.col("meta.git")).alias("set_git"),
        F.when(own_meta, F.col("meta.source")).alias("set_source"),
        F.when(own_meta | (kind != "meta"), F.col("set_cwd")).alias("own_cwd"),
        F.when(is_start, F.struct(
            F.col("block"), F.col("ord"), F.col("turn_id"),
            delta.alias("delta_ms"),
            epoch_to_ts(F.col("started_at"), F.coalesce(outer, F.timestamp_millis(F.lit(0))))
            .alias("at"),
        )).alias("start_here"),
        F.when(F.col("turn_id").isNotNull(), _position()).alias("turn_position"),
        F.when(F.col("usage.last.t") > 0, F.col("usage.total.t")).alias("counter"),
    )


def _values() -> dict[str, Running]:
    """Everything that a record inherits from those before it in its file."""
    return {
        "model": Running("last", F.col("set_model")),
        "effort": Running("last", F.col("set_effort")),
        "cwd": Running("last", F.col("own_cwd")),
        "git": Running("last", F.col("set_git")),
        "raw_source": Running("last", F.col("set_source")),
        # A struct, so that a settings record without a tier overwrites with null.
        "tier_cell": Running("last", F.col("set_tier")),
        "turn": Running("last", F.col("turn_id")),
        "start": Running("last", F.col("start_here")),
        "first_turn": Running("min", F.col("turn_position")),
        "counter_before": Running("last", F.col("counter"), before=True),
    }


def file_state(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What each file's records leave to those that are appended later; one row per file."""
    return closing(_prepared(records), [ACCOUNT, "file"], POSITION, _values(), before)


def with_context(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Carry model, effort, cwd, repository, source, tier and turn forward within each file.

    Values not yet set are null; thread state fills them in later (a carried value always wins over
    state, so filling late gives the same result and keeps the records independent of state). For
    the tails of files, ``before`` is the ``file_state`` of what was read earlier.
    """
    carried = running(
        _prepared(records),
        keys=[ACCOUNT, "file"],
        chunk="block",
        order=["ord"],
        values=_values(),
        carried_rows=F.col("split"),
        initial=before,
    )
    # A task start counts only once the file has named a turn; starts before that are unusable,
    # and as turns are never unset, the latest start is usable or none is.
    usable = F.struct(F.col("start.block"), F.col("start.ord")) >= F.col("first_turn")
    start = F.when(usable, F.col("start"))
    return carried.select(
        ACCOUNT, "file", *POSITION, "kind", "turn_id", "meta", "call", "usage", "limits",
        "model", "effort", "cwd", "git", "raw_source",
        F.col("tier_cell.tier").alias("service_tier"),
        F.col("turn"),
        start.alias("start"),
        F.coalesce(start["delta_ms"] <= ORIGINAL_MAX_DELTA_MS, F.lit(False))
        .alias("original_likely"),
        safe_ts(F.col("at"), F.coalesce(start["at"], F.timestamp_millis(F.lit(0)))).alias("ts"),
        "counter_before",
        thread_id_of_file(F.col("file")).alias("file_thread"),
    )


def turn_parts(ctx: DataFrame) -> DataFrame:
    """What records tell of each usable task start: `s` from the start itself, `c` from its turn's
    latest record, at `c_at`. Parts of one start, from several reads of a file, add up."""
    rows = ctx.filter(
        F.col("start").isNotNull()
        & ((F.col("kind") == "start")
           | ((F.col("kind") == "turn") & (F.col("turn") == F.col("start.turn_id"))))
    )
    captured = F.when(F.col("kind") == "start", F.struct(
        "turn", F.col("file_thread").alias("thread_id"), F.col("start.at").alias("at"),
        F.col("start.delta_ms").alias("delta_ms"), "git", "raw_source", "service_tier",
    ))
    settled = F.struct("model", "effort", "cwd")
    return (
        rows.groupBy(
            ACCOUNT, "file", F.col("start.block").alias("block"), F.col("start.ord").alias("ord")
        )
        .agg(F.max(captured).alias("s"), F.max_by(settled, _position()).alias("c"),
             F.max(_position()).alias("c_at"), F.max("turn").alias("own_turn"))
    )


def merge_turn_parts(parts: DataFrame) -> DataFrame:
    """One row per task start from several parts of it."""
    return parts.groupBy(ACCOUNT, "file", *POSITION).agg(
        F.max("s").alias("s"), F.max_by("c", "c_at").alias("c"), F.max("c_at").alias("c_at"),
        F.max("own_turn").alias("own_turn"))


def settled_turns(parts: DataFrame) -> DataFrame:
    """Turn candidates from merged parts."""
    return parts.select(ACCOUNT, "file", *POSITION, "s.*", "c.*")


def turn_candidates(ctx: DataFrame) -> DataFrame:
    """One row per usable task start, with the context its turn ended up with in the file."""
    return settled_turns(turn_parts(ctx))


def token_records(ctx: DataFrame) -> DataFrame:
    """Model calls: token counts whose last call used tokens."""
    u = F.col("usage")
    return ctx.filter((F.col("kind") == "tokens") & (u["last"]["t"] > 0)).select(
        ACCOUNT, "file", *POSITION, "turn", "ts", "original_likely",
        F.col("file_thread").alias("thread_id"),
        "model", "effort", "cwd", "git", "raw_source", "service_tier",
        u["total"].alias("total"), u["last"].alias("last"),
        u["context_window"].alias("context_window"),
        F.coalesce(u["total"]["t"] < F.col("counter_before"), F.lit(False)).alias("correction"),
    )


CALL_SERIES = [ACCOUNT, "file", "turn", "type", "name"]


def call_records(ctx: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Tool calls, numbered within (file, turn, type, name).

    ``before`` has each series' ``ordinal`` so far, for the tails of files.
    """
    calls = ctx.filter(F.col("kind") == "call").select(
        ACCOUNT, "file", *POSITION, F.coalesce("turn", F.lit("")).alias("turn"),
        "original_likely", F.col("file_thread").alias("thread_id"),
        F.col("call.type").alias("type"), F.col("call.name").alias("name"),
        F.col("call.stable_id").alias("stable_id"),
    )
    return running(
        calls,
        keys=CALL_SERIES,
        chunk="block",
        order=["ord"],
        values={"ordinal": Running("sum", F.lit(1).cast("long"))},
        initial=before,
    )


def quota_records(ctx: DataFrame) -> DataFrame:
    """Quota readings: one row per bucket that names a window and a reset."""
    lim = F.col("limits")
    part = F.posexplode(lim["buckets"]).alias("part", "bucket")
    return (
        ctx.filter(F.col("kind") == "tokens")
        .select(ACCOUNT, "file", *POSITION, "ts", "original_likely",
                hash_id(lim["limit"], 16).alias("limit_key"),
                lim["limit_name"].alias("limit_name"), lim["plan_type"].alias("plan_type"), part)
        .select(ACCOUNT, "file", *POSITION, "part", "ts", "original_likely", "limit_key",
                "limit_name", "plan_type", "bucket.*")
        .filter((F.col("window_minutes") != 0) & (F.col("resets_at") != 0))
    )


def file_counters(ctx: DataFrame) -> DataFrame:
    """Parse errors and counter corrections per file."""
    drop = (F.col("kind") == "tokens") & (F.col("usage.last.t") > 0) & (
        F.col("usage.total.t") < F.col("counter_before"))
    return ctx.filter(F.col("kind").isin("bad", "tokens")).groupBy(ACCOUNT, "file").agg(
        F.count_if(F.col("kind") == "bad").alias("parse_errors"),
        F.count_if(F.coalesce(drop, F.lit(False))).alias("correction_intervals"),
    )


def parent_candidates(ctx: DataFrame) -> DataFrame:
    """Parents named by a file's own session records; a spawning parent beats a forked one."""
    m = F.col("meta")
    return ctx.filter((F.col("kind") == "meta") & (m["id"] == F.col("file_thread"))).select(
        ACCOUNT, "file", *POSITION, F.col("file_thread").alias("thread_id"),
        F.coalesce(m["spawner"], m["parent"]).alias("parent_thread_id"),
    ).filter("parent_thread_id is not null")
