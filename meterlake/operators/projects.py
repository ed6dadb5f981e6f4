"""Usage by project, model and usage type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import (
    OTHER_ACTIVITY,
    UNLABELLED,
    clean_label,
    short_label,
    usage_type_key,
    usage_type_label,
)
from meterlake.functions.models import (
    DASHBOARD_FAMILIES,
    RATE_CARD,
    Rate,
    dashboard_family,
    event_credits,
    project_family_of,
)
from meterlake.functions.numbers import non_negative
from meterlake.keys import ACCOUNT


def _zero() -> Column:
    return F.lit(0).cast("long")


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), _zero())


def _has_stored_credits() -> Column:
    c = F.col("rate_card_credits")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def singleton_projects(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Projects with exactly one thread over the whole ledger, events and threads together."""
    pairs = events.select(ACCOUNT, "project", "thread_id").unionByName(
        threads.select(ACCOUNT, "project", F.col("id").alias("thread_id"))
    ).filter((F.col("project") != "") & (F.col("thread_id") != ""))
    # Two different threads show as differing extremes, so no distinct set has to be kept.
    stored = pairs.groupBy(ACCOUNT, "project").agg(
        F.min("thread_id").alias("lo"), F.max("thread_id").alias("hi"))
    return (
        stored.withColumn("project", clean_label(F.col("project"), UNLABELLED))
        .groupBy(ACCOUNT, "project").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo = hi")
        .select(ACCOUNT, "project")
    )


def _with_project(events: DataFrame, singles: DataFrame | None) -> DataFrame:
    named = events.withColumn("project", clean_label(F.col("project"), UNLABELLED))
    if singles is None:
        return named
    flagged = named.join(
        singles.withColumn("single", F.lit(True)), [ACCOUNT, "project"], "left")
    return flagged.withColumn(
        "project", F.when(F.col("single"), F.lit(OTHER_ACTIVITY)).otherwise(F.col("project"))
    ).drop("single")


def _sums(*names: str) -> list[Column]:
    return [F.sum(_num(n)).alias(n) for n in names]


def project_usage(events: DataFrame, singles: DataFrame | None = None) -> DataFrame:
    """Usage per project; one-thread projects fold into `Other activity` when they are given.

    Folding happens after a first reduction by project, so only small rows meet the singletons.
    """
    slim = events.select(
        ACCOUNT, "project", "thread_id", "total_tokens", "output_tokens", "reasoning_tokens",
        "tool_calls", "rate_card_credits")
    stored = _has_stored_credits()
    # First by (project, thread) as stored: labels are then cleaned once per group, and folded
    # projects count threads once per distinct thread.
    per_thread = slim.groupBy(
        ACCOUNT, "project", F.nullif("thread_id", F.lit("")).alias("thread_id")).agg(
        *_sums("total_tokens", "output_tokens", "reasoning_tokens", "tool_calls"),
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(F.when(stored, F.col("rate_card_credits"))), F.lit(0.0))
        .alias("rate_card_credits"),
        F.sum(F.when(stored, _num("total_tokens")).otherwise(0)).alias("known_credit_tokens"),
    )
    folded = _with_project(per_thread, singles)
    names = ["total_tokens", "output_tokens", "reasoning_tokens", "tool_calls", "events",
             "rate_card_credits", "known_credit_tokens"]
    return folded.groupBy(ACCOUNT, "project").agg(
        *[F.sum(n).alias(n) for n in names],
        F.count_distinct("thread_id").alias("threads"),
    ).withColumn("display_project", short_label(F.col("project")))


def project_model_mix(events: DataFrame, singles: DataFrame | None = None) -> DataFrame:
    """Usage per (project, model label), one row each."""
    stored = _has_stored_credits()
    per = events.groupBy(ACCOUNT, "project", "model").agg(
        *_sums("total_tokens"), F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(F.when(stored, F.col("rate_card_credits"))), F.lit(0.0))
        .alias("rate_card_credits"))
    labelled = per.withColumn("model", clean_label(F.col("model"), "Unknown model")).withColumn(
        "model", project_family_of(F.col("model")))
    return _with_project(labelled, singles).groupBy(ACCOUNT, "project", "model").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("events").alias("events"),
        F.sum("rate_card_credits").alias("rate_card_credits"))


def top_models(mix: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` models of each project by tokens, with their share of the project."""
    w = Window.partitionBy(ACCOUNT, "project")
    ranked = mix.withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("total_tokens"), F.asc("model"))))
    totals = mix.groupBy(ACCOUNT, "project").agg(F.sum("total_tokens").alias("project_tokens"))
    return ranked.filter(F.col("rank") <= n).join(totals, [ACCOUNT, "project"]).withColumn(
        "share", percent_of(F.col("total_tokens"), F.col("project_tokens"))
    ).drop("project_tokens")


def with_share(rows: DataFrame) -> DataFrame:
    """Token and credit shares of each row in its account's total."""
    totals = rows.groupBy(ACCOUNT).agg(
        F.sum("total_tokens").alias("all_tokens"), F.sum("rate_card_credits").alias("all_credits"))
    credits = F.coalesce("rate_card_credits", F.lit(0.0))
    base = F.when(F.col("all_credits") != 0, F.col("all_credits")).otherwise(1.0)
    return rows.join(totals, ACCOUNT).select(
        *rows.columns,
        percent_of(F.col("total_tokens"), F.col("all_tokens")).alias("share"),
        F.when(credits > 0, credits / base * 100).otherwise(0.0).alias("credit_share"),
    )


def top_projects(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` projects of each account, by tokens, then name."""
    if not 1 <= n <= 100:
        raise ValueError("top must be between 1 and 100.")
    w = Window.partitionBy(ACCOUNT).orderBy(F.desc("total_tokens"), F.asc("project"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def usage_summary(events: DataFrame) -> DataFrame:
    """Totals per account."""
    held = F.least(non_negative(F.col("input_tokens")), non_negative(F.col("cached_input_tokens")))
    stored = _has_stored_credits()
    return events.groupBy(ACCOUNT).agg(
        *_sums("total_tokens", "output_tokens", "input_tokens", "tool_calls"),
        F.sum(held).alias("cached_input_tokens"),
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct(F.nullif("thread_id", F.lit(""))).alias("threads"),
        F.coalesce(F.sum(F.when(stored, F.col("rate_card_credits"))), F.lit(0.0))
        .alias("rate_card_credits"),
        F.sum(F.when(stored, _num("total_tokens")).otherwise(0)).alias("known_credit_tokens"),
    ).withColumn(
        "uncached_input_tokens",
        F.greatest(_zero(), F.col("input_tokens") - F.col("cached_input_tokens")))


def cache_coverage(events: DataFrame) -> DataFrame:
    """Cached and uncached share of the input."""
    s = usage_summary(events)
    return s.select(
        ACCOUNT, "input_tokens", "cached_input_tokens", "uncached_input_tokens",
        percent_of(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cached_share"),
        percent_of(F.col("uncached_input_tokens"), F.col("input_tokens")).alias("uncached_share"),
    )



def model_totals(events: DataFrame) -> DataFrame:
    """Tokens per dashboard family, every family listed in fixed order."""
    tokens = {
        f: F.sum(F.when(F.col("model") == f, F.col("total_tokens")).otherwise(0))
        for f in DASHBOARD_FAMILIES
    }
    slim = events.select(
        ACCOUNT, dashboard_family(F.col("model")).alias("model"),
        _num("total_tokens").alias("total_tokens"))
    # The families are few and fixed, so one aggregate row per account holds them all.
    wide = slim.groupBy(ACCOUNT).agg(
        F.sum("total_tokens").alias("all_tokens"),
        F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(f).alias("model"),
                     c.alias("total_tokens"))
            for i, (f, c) in enumerate(tokens.items())
        ]).alias("families"))
    return wide.select(ACCOUNT, "all_tokens", F.inline("families")).select(
        ACCOUNT, "model", "position", "total_tokens",
        percent_of(F.col("total_tokens"), F.col("all_tokens")).alias("share"))


def usage_types(events: DataFrame) -> DataFrame:
    """Tokens per usage type."""
    return events.groupBy(ACCOUNT, usage_type_key(F.col("use_type")).alias("use_type")).agg(
        *_sums("total_tokens")).withColumn("label", usage_type_label(F.col("use_type")))


def fold_tail(
    rows: DataFrame, key: str, keep: int = 4, limit: int = 5, other: str = "other",
    label: str | None = "label", other_label: str = "Other",
) -> DataFrame:
    """When an account has more than ``limit`` rows, merge those past the first ``keep``."""
    w = Window.partitionBy(ACCOUNT).orderBy(F.desc("total_tokens"), F.asc(key))
    # Only the leading rows are ranked; the rest is what their total leaves over.
    lead = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    totals = rows.groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("all_tokens"))
    cut = lead.join(totals, ACCOUNT)
    head = cut.filter((F.col("n") <= limit) | (F.col("rank") <= keep))
    cols = [ACCOUNT, key, *([label] if label else []), "total_tokens", "rank", "n"]
    rest = head.filter(F.col("n") > limit).groupBy(ACCOUNT).agg(
        (F.first("all_tokens") - F.sum("total_tokens")).alias("total_tokens"),
        F.first("n").alias("n"),
    ).select(
        ACCOUNT, F.lit(other).alias(key), *([F.lit(other_label).alias(label)] if label else []),
        "total_tokens", F.lit(keep + 1).alias("rank"), "n")
    return head.select(*cols).unionByName(rest).drop("n")


def credits_by_model(events: DataFrame, rates: dict[str, Rate] = RATE_CARD) -> DataFrame:
    """Recomputed credits per model name, with each model's share of the account's credits."""
    per = events.withColumn("c", event_credits(rates)).groupBy(ACCOUNT, "model").agg(
        *_sums("total_tokens"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("rate_card_credits"))
    return with_share(per)


def rate_summary(events: DataFrame, rates: dict[str, Rate] = RATE_CARD) -> DataFrame:
    """Rated tokens, credits and priority credits under the current card."""
    slim = events.select(
        ACCOUNT, non_negative(F.col("total_tokens")).alias("tokens"),
        event_credits(rates).alias("c"), (F.col("service_tier") == "priority").alias("fast"))
    return slim.groupBy(ACCOUNT).agg(
        F.sum("tokens").alias("total_tokens"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tokens")).otherwise(0)).alias("rated_tokens"),
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("credits"),
        F.coalesce(F.sum(F.when(F.col("fast"), F.col("c"))), F.lit(0.0)).alias("priority_credits"),
    ).withColumn("coverage_percent", percent_of(F.col("rated_tokens"), F.col("total_tokens")))


def project_totals_plain(events: DataFrame) -> DataFrame:
    """Tokens per project without folding; only tabs and line breaks are cleaned."""
    raw = F.coalesce(F.nullif("project", F.lit("")), F.lit(UNLABELLED))
    name = F.btrim(F.regexp_replace(raw, r"[\t\r\n]+", " "))
    return events.filter(F.col("total_tokens") > 0).groupBy(
        ACCOUNT, F.coalesce(F.nullif(name, F.lit("")), F.lit(UNLABELLED)).alias("project")
    ).agg(F.sum("total_tokens").alias("total_tokens"))
