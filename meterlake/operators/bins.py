"""Token columns over calendar days and the figures read off them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.models import family_order, trend_family
from meterlake.functions.numbers import local_date, non_negative
from meterlake.keys import ACCOUNT
from meterlake.operators.burn import _bin_of, bin_days
from meterlake.operators.projects import percent_of
from meterlake.operators.windows import Bounds, in_window

MIN_PRIOR_TOKENS = 1_000_000


def choose_bin_size(
    days: int, width: float, min_bin_width: float = 1, prefer_daily: bool = False
) -> int:
    """Days per column so that the columns fit the width."""
    room = max(1, math.floor(max(1, width) / max(1, min_bin_width)))
    if prefer_daily or days <= 14:
        wanted = 1
    else:
        wanted = 2 if max(1, width) >= 120 else 3
    return max(wanted, math.ceil(days / room))


def token_bins(events: DataFrame, b: Bounds, size: int = 1) -> DataFrame:
    """Tokens, priority tokens and calls per bin and trend family."""
    tokens = non_negative(F.col("total_tokens"))
    slim = in_window(events, b).select(
        ACCOUNT, _bin_of(local_date(F.col("ts"), b.tz), b, size).alias("bin"),
        trend_family(F.col("model")).alias("model"), tokens.alias("tokens"),
        F.when(F.col("service_tier") == "priority", tokens).otherwise(0).alias("fast"))
    return slim.groupBy(ACCOUNT, "bin", "model").agg(
        F.sum("tokens").alias("tokens"), F.sum("fast").alias("fast_tokens"),
        F.count(F.lit(1)).alias("calls"),
    ).select(ACCOUNT, "bin", *bin_days(F.col("bin"), b, size), "model", "tokens", "fast_tokens",
             "calls")


def bin_count(b: Bounds, size: int) -> int:
    return math.ceil(b.days / size)


def bin_totals(bins: DataFrame, b: Bounds, size: int = 1) -> DataFrame:
    """Every bin of every account that has any, with zeros where nothing happened."""
    spine = bins.select(ACCOUNT).distinct().select(
        ACCOUNT, F.explode(F.sequence(F.lit(0), F.lit(bin_count(b, size) - 1))).alias("bin"))
    sums = bins.groupBy(ACCOUNT, "bin").agg(
        F.sum("tokens").alias("tokens"), F.sum("fast_tokens").alias("fast_tokens"),
        F.sum("calls").alias("calls"))
    return spine.join(sums, [ACCOUNT, "bin"], "left").select(
        ACCOUNT, "bin", *bin_days(F.col("bin"), b, size),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "fast_tokens", "calls")])


def family_totals(bins: DataFrame) -> DataFrame:
    """Window totals per trend family."""
    return bins.groupBy(ACCOUNT, "model").agg(
        F.sum("tokens").alias("tokens"), F.sum("fast_tokens").alias("fast_tokens"),
        F.sum("calls").alias("calls"))


def fast_share(bins: DataFrame) -> DataFrame:
    """Priority share of tokens per family; the row without a family is the account's."""
    per = family_totals(bins)
    # Families are few, so the account row is summed from them.
    whole = per.groupBy(ACCOUNT).agg(
        F.sum("tokens").alias("tokens"), F.sum("fast_tokens").alias("fast_tokens"))
    rows = per.select(ACCOUNT, "model", "tokens", "fast_tokens").unionByName(
        whole.withColumn("model", F.lit(None).cast("string")))
    return rows.withColumn("fast_share", percent_of(F.col("fast_tokens"), F.col("tokens")))


def model_cards(bins: DataFrame, n: int = 3, least_share: float = 0.01) -> DataFrame:
    """The leading families with at least one percent of the tokens."""
    per = family_totals(bins)
    totals = per.groupBy(ACCOUNT).agg(F.sum("tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens"))
    w = Window.partitionBy(ACCOUNT).orderBy(
        F.desc("tokens"), family_order(F.col("model")), F.asc("model"))
    return (
        per.join(totals, ACCOUNT)
        .select(ACCOUNT, "model", "tokens", (share * 100).alias("share"), share.alias("_s"))
        .filter((F.col("tokens") > 0) & (F.col("_s") >= least_share)).drop("_s")
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def period_delta(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Change of each family against the period before, where that had enough tokens.

    ``delta_percent`` is the change; ``ratio`` is what a report shows from five-fold up.
    """
    before = prior.select(ACCOUNT, "model", F.col("tokens").alias("prior_tokens"))
    ratio = F.when(F.col("prior_tokens") >= MIN_PRIOR_TOKENS,
                   F.col("tokens") / F.col("prior_tokens"))
    return current.join(before, [ACCOUNT, "model"], "left").select(
        ACCOUNT, "model", "tokens", F.coalesce("prior_tokens", F.lit(0)).alias("prior_tokens"),
        ratio.alias("ratio"), ((ratio - 1) * 100).alias("delta_percent"),
        F.when(ratio >= 5, "ratio").when(ratio.isNotNull(), "percent").alias("shown_as"))


def burn_rates(stats: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Tokens per meter point of the chosen families that have a rate."""
    rows = stats.filter(F.col("tokens_per_burn_point") > 0)
    if families is None:
        families = ["Luna", "Sol"]
    return rows.filter(F.col("model").isin(families)).select(
        ACCOUNT, "model", "tokens_per_burn_point", "burn_points")


def top_with_rest(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` projects, then one row for the others.

    A single other keeps its name. ``top_share`` is the leading rows' part of all tokens.
    """
    w = Window.partitionBy(ACCOUNT).orderBy(F.desc("total_tokens"), F.asc("project"))
    lead = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n + 1)
    totals = rows.groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("all_tokens"))
    top = lead.filter(F.col("rank") <= n).groupBy(ACCOUNT).agg(
        F.sum("total_tokens").alias("top_tokens"))
    t = lead.join(totals, ACCOUNT).join(top, ACCOUNT)
    rest = F.col("rank") > n
    name = F.coalesce("display_project", "project") if "display_project" in rows.columns else (
        F.col("project"))
    others = F.col("n") - F.lit(n)
    label: Column = F.when(
        rest & (others > 1), F.concat(others.cast("string"), F.lit(" other projects"))
    ).otherwise(name)
    return t.select(
        ACCOUNT, "rank", label.alias("name"),
        F.when(rest, F.col("all_tokens") - F.col("top_tokens")).otherwise(F.col("total_tokens"))
        .alias("tokens"),
        rest.alias("is_rest"), F.col("n").alias("projects"),
        percent_of(F.col("top_tokens"), F.col("all_tokens")).alias("top_share"))
