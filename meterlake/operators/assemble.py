"""From winners to the ledger tables: events, threads and coverage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import project_label, safe_title, source_labels
from meterlake.functions.models import (
    RATE_CARD,
    RATE_CARD_AS_OF,
    RATE_CARD_URL,
    Rate,
    credits,
    normalize_model,
    with_priority,
)
from meterlake.functions.numbers import epoch_to_ts, finite_number, has_breakdown, usage_struct
from meterlake.keys import ACCOUNT, WEEK_MINUTES

# Notes and provenance stored with a ledger.
COVERAGE_NOTES = [
    "Observed totals sum globally de-duplicated last_token_usage model-call events.",
    "Codex thread counters are retained only as non-additive reference values because forks and "
    "subagents inherit cumulative history.",
    "Historical rollout files can be pruned; a state-only counter cannot reveal that thread's "
    "unique token contribution.",
    "Legacy events without turn IDs use a high-specificity usage-signature heuristic and are "
    "labeled in the ledger.",
]
PROVENANCE_KIND = "codex-local-metadata"
PROVENANCE_LABEL = "Local Codex snapshot"
PROVENANCE_PRIVACY = (
    "Contains token metadata and Codex display titles only; credential fields, message bodies, "
    "reasoning text, tool payloads, and full local paths are not exported. Display titles may "
    "contain user-written text."
)
SCHEMA_VERSION = 1


def thread_facts(state: DataFrame, titles: DataFrame, parents: DataFrame) -> DataFrame:
    """All that is known about a thread apart from its log records; one row per thread."""
    row = state.select(
        ACCOUNT, F.col("id").alias("thread_id"), F.lit(True).alias("in_state"),
        F.struct("created_at", "updated_at", "source", "cwd", "title", "name", "tokens_used",
                 "git_origin_url", "agent_nickname", "model", "reasoning_effort",
                 "thread_source").alias("row"),
    ).groupBy(ACCOUNT, "thread_id").agg(
        F.max("row").alias("row"), F.max("in_state").alias("in_state"))
    keys = [ACCOUNT, "thread_id"]
    return row.join(titles, keys, "full_outer").join(parents, keys, "full_outer")


def _labels(model: Column, effort: Column, cwd: Column, git: Column, raw_source: Column) -> Column:
    """Labels of a thread, with its state row behind the values at hand."""
    row = F.col("row")

    def blank(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    kinds = source_labels(
        row["thread_source"], F.coalesce(blank(raw_source), blank(row["source"])))
    unknown = F.lit("unknown")
    return F.struct(
        safe_title(F.col("session_title"), row["title"], row["name"], row["thread_source"],
                   row["source"], row["agent_nickname"], F.col("thread_id")).alias("title"),
        project_label(F.coalesce(blank(cwd), row["cwd"]),
                      F.coalesce(blank(git), row["git_origin_url"])).alias("project"),
        normalize_model(F.coalesce(blank(model), blank(row["model"]), unknown)).alias("model"),
        F.coalesce(blank(effort), blank(row["reasoning_effort"]), unknown).alias("effort"),
        kinds["source"].alias("source"),
        kinds["use_type"].alias("use_type"),
    )


def attribute(calls: DataFrame, origins: DataFrame) -> DataFrame:
    """Give each call to the thread its turn began in.

    Labels come from the turn's origin where there is one. A copy also takes the origin's service
    tier, even an empty one; the time is always the call's own.
    """
    o = F.col("origin")
    has = o.isNotNull()

    def pick(name: str) -> Column:
        return F.when(has, o[name]).otherwise(F.col(name)).alias(name)

    own_tier = F.col("original_likely") | ~has
    # Calls without a turn have no origin; they may be many, so they do not meet in the join.
    found = calls.filter("turn IS NOT NULL").join(origins, [ACCOUNT, "turn"], "left").unionByName(
        calls.filter("turn IS NULL"), allowMissingColumns=True)
    return found.select(
        ACCOUNT, "id", "turn", "ts", "seen", "copies", "last", "dedupe_quality",
        pick("thread_id"), pick("model"), pick("effort"), pick("cwd"), pick("git"),
        pick("raw_source"),
        F.when(own_tier, F.col("service_tier")).otherwise(o["service_tier"]).alias("service_tier"),
    )


def price_events(
    attributed: DataFrame, facts: DataFrame, rates: dict[str, Rate] = RATE_CARD
) -> DataFrame:
    """Labelled and priced events, without tool calls yet."""
    lab = _labels(*[F.col(c) for c in ("model", "effort", "cwd", "git", "raw_source")])
    u = F.col("last")
    usage = usage_struct(u["i"], u["c"], u["w"], u["o"], u["r"], u["t"])
    labelled = attributed.join(facts, [ACCOUNT, "thread_id"], "left").select(
        ACCOUNT, "id", "ts", "thread_id", lab.alias("lab"), F.coalesce("turn", F.lit(""))
        .alias("turn_id"), F.nullif("service_tier", F.lit("")).alias("service_tier"),
        usage.alias("u"), "dedupe_quality", "seen",
    ).select("*", "u.*").drop("u")
    price = credits(
        F.col("lab.model"), F.col("input_tokens"), F.col("cached_input_tokens"),
        F.col("output_tokens"), F.col("total_tokens"), rates, clamp=False)
    return labelled.select(
        ACCOUNT, "id", "ts", "thread_id", F.col("lab.title").alias("thread_title"),
        "lab.project", "lab.model", "lab.effort", "lab.source", "lab.use_type", "turn_id",
        "service_tier", "input_tokens", "cached_input_tokens", "cache_write_input_tokens",
        "output_tokens", "reasoning_tokens", "total_tokens",
        with_priority(price, F.col("service_tier")).alias("rate_card_credits"),
        has_breakdown(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"))
        .alias("breakdown_available"),
        "dedupe_quality", "seen",
    )


def since(df: DataFrame, start: datetime | Column | None) -> DataFrame:
    """Drop rows before an instant; rows at it stay."""
    if start is None:
        return df
    return df.filter(F.col("ts") >= (start if isinstance(start, Column) else F.lit(start)))


def event_order() -> Column:
    """Time order of events; ties keep first-seen order."""
    return F.struct("ts", "seen")


def call_group(turn: Column, thread: Column) -> Column:
    """What a tool call is counted with: its turn, else its thread."""
    return F.coalesce(F.nullif(turn, F.lit("")), F.concat(F.lit("thread:"), thread))


def attach_tool_calls(events: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Put a turn's tool-call count on its last event; calls without an event are lost."""
    group = call_group(F.col("turn_id"), F.col("thread_id"))
    last = events.groupBy(ACCOUNT, group.alias("call_group")).agg(
        F.max_by("id", event_order()).alias("id"))
    counts = tool_calls.groupBy(
        ACCOUNT, call_group(F.col("turn"), F.col("thread_id")).alias("call_group")
    ).agg(F.count(F.lit(1)).alias("n"))
    on_event = last.join(counts, [ACCOUNT, "call_group"]).select(ACCOUNT, "id", "n")
    return events.join(on_event, [ACCOUNT, "id"], "left").withColumn(
        "tool_calls", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def rollup_threads(events: DataFrame, facts: DataFrame, origins: DataFrame) -> DataFrame:
    """One row per thread of the log or of the state table."""
    def total(name: str) -> Column:
        return F.sum(name).alias(name)

    detailed = F.when(F.col("breakdown_available"), F.col("total_tokens")).otherwise(0)
    rated = F.when(F.col("rate_card_credits").isNotNull(), F.col("total_tokens")).otherwise(0)
    sums = events.groupBy(ACCOUNT, "thread_id").agg(
        F.min_by(F.struct("turn_id", "model", "effort"), event_order()).alias("first"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        total("total_tokens"), total("input_tokens"), total("cached_input_tokens"),
        total("output_tokens"), total("reasoning_tokens"), total("tool_calls"),
        F.sum(detailed).alias("detailed_tokens"), F.sum(rated).alias("rated_tokens"),
        F.sum("rate_card_credits").alias("credits"), F.count(F.lit(1)).alias("event_count"),
    ).withColumn("turn", F.nullif("first.turn_id", F.lit("")))
    with_origin = sums.join(origins, [ACCOUNT, "turn"], "left").drop("turn")
    known = facts.filter("in_state")
    rows = with_origin.join(facts, [ACCOUNT, "thread_id"], "left").unionByName(
        known.join(sums.select(ACCOUNT, "thread_id"), [ACCOUNT, "thread_id"], "left_anti"),
        allowMissingColumns=True,
    )
    o, first, row = F.col("origin"), F.col("first"), F.col("row")
    lab = _labels(
        F.coalesce(o["model"], F.when(o.isNull(), first["model"])),
        F.coalesce(o["effort"], F.when(o.isNull(), first["effort"])),
        o["cwd"], o["git"], o["raw_source"])
    n = F.coalesce("event_count", F.lit(0))
    zero = [c for c in ("total_tokens", "detailed_tokens", "input_tokens", "cached_input_tokens",
                        "output_tokens", "reasoning_tokens", "rated_tokens", "tool_calls")]
    filled = rows.select(
        ACCOUNT, "thread_id", lab.alias("lab"), "parent_thread_id",
        F.coalesce("first_ts", epoch_to_ts(row["created_at"])).alias("first_active_at"),
        F.coalesce("last_ts", epoch_to_ts(row["updated_at"])).alias("last_active_at"),
        F.when(row["tokens_used"].isNotNull(), finite_number(row["tokens_used"]).cast("long"))
        .alias("reported_cumulative_tokens"),
        n.alias("event_count"), "credits", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
    ).filter((F.col("event_count") > 0)
             | (F.coalesce("reported_cumulative_tokens", F.lit(0)) > 0))
    tokens, det = F.col("total_tokens"), F.col("detailed_tokens")
    return filled.select(
        ACCOUNT, F.col("thread_id").alias("id"), "lab.title", "lab.project", "lab.model",
        "lab.effort", "lab.source", "lab.use_type", "parent_thread_id", "first_active_at",
        "last_active_at", "total_tokens", "detailed_tokens",
        (tokens - det).alias("unknown_breakdown_tokens"), "reported_cumulative_tokens",
        "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens",
        F.when((tokens > 0) & (F.col("rated_tokens") == tokens), F.col("credits"))
        .alias("rate_card_credits"),
        "rated_tokens", "tool_calls", "event_count",
        F.when(F.col("event_count") == 0, "unresolved").when(det == tokens, "complete")
        .when(det > 0, "partial").otherwise("total-only").alias("coverage"),
    )


def window_complete(events: DataFrame, quota: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Whether the log reaches back to the start of the newest weekly window.

    The newest reading is taken from account-wide limits if there are any.
    """
    newest = quota.filter(F.col("window_minutes") == WEEK_MINUTES).groupBy(ACCOUNT).agg(
        F.min_by(
            F.col("resets_at") * 1_000 - F.lit(WEEK_MINUTES * 60_000),
            F.struct(F.nullif("limit_name", F.lit("")).isNotNull(), -F.unix_millis("ts"),
                     F.col("seen"))).alias("start_ms"))
    earliest = events.groupBy(ACCOUNT).agg(F.min("ts").alias("earliest"))
    return (
        newest.join(earliest, ACCOUNT, "left").join(parse_errors, ACCOUNT, "left")
        .select(ACCOUNT, (
            F.coalesce(F.unix_millis("earliest") <= F.col("start_ms"), F.lit(False))
            & (F.coalesce("parse_errors", F.lit(0)) == 0)
        ).alias("complete_since_window_start"))
    )


def coverage(
    sources: DataFrame, counters: DataFrame, calls: DataFrame, events: DataFrame,
    threads: DataFrame, quota: DataFrame,
) -> DataFrame:
    """One row per account on what was read and how far it can be trusted.

    ``sources``: (account_id, file, size); ``counters``: per-file parse errors and corrections.
    """
    files = sources.groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("files_scanned"), F.sum("size").alias("bytes_scanned"))
    errors = counters.groupBy(ACCOUNT).agg(
        F.sum("parse_errors").alias("parse_errors"),
        F.sum("correction_intervals").alias("correction_intervals"))
    dups = calls.groupBy(ACCOUNT).agg(F.sum(F.col("copies") - 1).alias("duplicate_events_skipped"))
    ev = events.groupBy(ACCOUNT).agg(
        F.sum("total_tokens").alias("observed_tokens"),
        F.sum(F.when(F.col("breakdown_available"), F.col("total_tokens")).otherwise(0))
        .alias("detailed_tokens"),
        F.count_if(F.col("dedupe_quality") == "legacy-heuristic").alias("legacy_heuristic_events"),
        F.min("ts").alias("earliest_event_at"), F.max("ts").alias("latest_event_at"))
    reported = F.coalesce("reported_cumulative_tokens", F.lit(0))
    th = threads.groupBy(ACCOUNT).agg(
        F.sum(reported).alias("state_counter_sum_non_additive"),
        F.count_if((F.col("coverage") == "unresolved") & (reported > 0))
        .alias("unresolved_thread_counters"))
    complete = window_complete(events, quota, errors.select(ACCOUNT, "parse_errors"))
    out = files
    for part in (errors, dups, ev, th, complete):
        out = out.join(part, ACCOUNT, "full_outer")
    zeros = [
        "files_scanned", "bytes_scanned", "parse_errors", "duplicate_events_skipped",
        "correction_intervals", "observed_tokens", "detailed_tokens",
        "state_counter_sum_non_additive", "unresolved_thread_counters", "legacy_heuristic_events",
    ]
    out = out.select(
        ACCOUNT, *[F.coalesce(c, F.lit(0)).alias(c) for c in zeros], "earliest_event_at",
        "latest_event_at",
        F.coalesce("complete_since_window_start", F.lit(False))
        .alias("complete_since_window_start"))
    seen, det = F.col("observed_tokens"), F.col("detailed_tokens")
    return out.select(
        "*", (seen - det).alias("unknown_breakdown_tokens"),
        F.when(seen > 0, det / seen * 100).otherwise(100.0).alias("detailed_percent"),
        F.array(*[F.lit(n) for n in COVERAGE_NOTES]).alias("notes"),
    )


def provenance(spark: SparkSession, generated_at: datetime) -> DataFrame:
    """One row describing a ledger."""
    return spark.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.lit(PROVENANCE_LABEL).alias("label"),
        F.lit(PROVENANCE_KIND).alias("kind"),
        F.lit(PROVENANCE_PRIVACY).alias("privacy"),
        F.lit(RATE_CARD_AS_OF).alias("rate_card_as_of"),
        F.lit(RATE_CARD_URL).alias("rate_card_url"),
    )


__all__ = [
    "attach_tool_calls", "attribute", "call_group", "coverage", "event_order", "price_events",
    "provenance", "rollup_threads", "since", "thread_facts", "window_complete",
]
