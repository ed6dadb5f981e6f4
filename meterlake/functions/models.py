"""Model names, families and prices."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import IN_CLASS, WHITE_SPACE, clean_label
from meterlake.functions.numbers import has_breakdown


@dataclass(frozen=True)
class Rate:
    """Credits per million tokens."""

    input: float
    cached: float
    output: float


# The published rate card, its date and source, and the fast-mode factor.
RATE_CARD = {
    "gpt-5.6-sol": Rate(125.0, 12.5, 750.0),
    "gpt-5.6-terra": Rate(50.0, 5.0, 300.0),
    "gpt-5.6-luna": Rate(5.0, 0.5, 30.0),
    "gpt-5.5": Rate(125.0, 12.5, 750.0),
    "gpt-5.5-cyber": Rate(500.0, 50.0, 3000.0),
    "gpt-5.4": Rate(62.5, 6.25, 375.0),
    "gpt-5.4-mini": Rate(18.75, 1.875, 113.0),
    "gpt-5.3-codex": Rate(43.75, 4.375, 350.0),
    "gpt-5.2": Rate(43.75, 4.375, 350.0),
}
RATE_CARD_AS_OF = "2026-08-17"
RATE_CARD_URL = "https://help.openai.com/en/articles/20001106"
PRIORITY_FACTOR = 1.5

# Report families in display order.
TREND_FAMILIES = [
    "Luna", "Sol", "Terra", "GPT-5.5", "GPT-5.4",
    "Daybreak", "Auto review", "Other", "Unknown", "Unattributed",
]
DASHBOARD_FAMILIES = ["Luna", "Sol", "Terra", "GPT", "Other"]


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def _first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def _dashed(model: Column) -> Column:
    """Model name in lower case with dashes for spaces and underscores."""
    raw = F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown"))
    return F.regexp_replace(F.lower(_trimmed(raw)), f"[{IN_CLASS}_]+", "-")


def _card_entry(model: Column, rates: dict[str, Rate]) -> Column:
    """The card entry a name begins with, or an empty text.

    Longer entries are tried first, so a variant never falls to its base model.
    """
    entries = sorted(rates, key=len, reverse=True)
    return F.regexp_extract(_dashed(model), "^(?:" + "|".join(map(re.escape, entries)) + ")", 0)


def normalize_model(model: Column, rates: dict[str, Rate] = RATE_CARD) -> Column:
    """Canonical model name: variants fall to their card entry, other names stay."""
    return F.coalesce(
        F.nullif(_card_entry(model, rates), F.lit("")),
        F.nullif(_dashed(model), F.lit("")),
        F.lit("unknown"),
    )


def _rate_map(rates: dict[str, Rate]) -> Column:
    """The card as one constant; a card is a handful of models."""
    cells = []
    for name, r in rates.items():
        cells += [F.lit(name), F.struct(
            F.lit(r.input).alias("input"), F.lit(r.cached).alias("cached"),
            F.lit(r.output).alias("output"))]
    return F.create_map(*cells)


def credits(
    model: Column,
    inp: Column,
    cached: Column,
    out: Column,
    total: Column,
    rates: dict[str, Rate] = RATE_CARD,
    clamp: bool = True,
) -> Column:
    """Price of a call in credits; null without a token breakdown or a rate.

    Reports hold negative counts at 0 (``clamp``); pricing at ingestion takes them as they are.
    """
    # Without a breakdown there is no entry, hence no rate and no price.
    entry = F.when(has_breakdown(inp, out, total), _card_entry(model, rates))
    rate = F.try_element_at(_rate_map(rates), entry)
    zero = F.lit(0).cast("long")
    i, c, o = (F.coalesce(x, zero) for x in (inp, cached, out))
    if clamp:
        i, c, o = (F.greatest(zero, x) for x in (i, c, o))
    hit = F.least(i, c)
    fresh = F.greatest(zero, i - hit)
    return (
        fresh * rate["input"] + hit * rate["cached"] + o * rate["output"]
    ) / F.lit(1_000_000.0)


def with_priority(price: Column, tier: Column, factor: float = PRIORITY_FACTOR) -> Column:
    return F.when(tier == "priority", price * F.lit(factor)).otherwise(price)


def event_credits(rates: dict[str, Rate] = RATE_CARD) -> Column:
    """Credits of a ledger event under the current card, else its stored credits as they are."""
    now = credits(
        F.col("model"), F.col("input_tokens"), F.col("cached_input_tokens"),
        F.col("output_tokens"), F.col("total_tokens"), rates,
    )
    stored = F.col("rate_card_credits")
    keep = stored.isNotNull() & ~F.isnan(stored) & (stored >= 0) & (stored < float("inf"))
    return F.coalesce(with_priority(now, F.col("service_tier")), F.when(keep, stored))



def project_family(model: Column) -> Column:
    """Label used in project tables: unknown models keep their cleaned name."""
    return project_family_of(clean_label(model, "Unknown model"))


def project_family_of(label: Column) -> Column:
    """Project-table label of an already cleaned model name."""
    low = F.lower(label)
    return _first_match(
        [
            (low.contains("sol"), F.lit("Sol")),
            (low.contains("luna"), F.lit("Luna")),
            (low.contains("terra"), F.lit("Terra")),
            (low == "gpt-5.5", F.lit("GPT-5.5")),
            (low == "gpt-5.4", F.lit("GPT-5.4")),
        ],
        label,
    )


def dashboard_family(model: Column) -> Column:
    """One of the five dashboard families."""
    low = F.lower(F.coalesce(model, F.lit("")))
    return _first_match(
        [
            (low.contains("sol"), F.lit("Sol")),
            (low.contains("luna"), F.lit("Luna")),
            (low.contains("terra"), F.lit("Terra")),
            (low.contains("gpt-5.5") | low.contains("gpt-5.4"), F.lit("GPT")),
        ],
        F.lit("Other"),
    )


def trend_family(model: Column) -> Column:
    """One of the trend families."""
    raw = F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown"))
    low = F.lower(_trimmed(raw))

    def versioned(base: str) -> Column:
        return (low == base) | low.startswith(base + "-")

    return _first_match(
        [
            (low.contains("luna"), F.lit("Luna")),
            (low.contains("sol"), F.lit("Sol")),
            (low.contains("terra"), F.lit("Terra")),
            (low.contains("daybreak"), F.lit("Daybreak")),
            (low.contains("auto-review"), F.lit("Auto review")),
            (versioned("gpt-5.5"), F.lit("GPT-5.5")),
            (versioned("gpt-5.4"), F.lit("GPT-5.4")),
            ((low == "unknown") | (low == ""), F.lit("Unknown")),
        ],
        F.lit("Other"),
    )


def family_order(family: Column) -> Column:
    """Display position of a trend family."""
    rules = [(family == name, F.lit(i)) for i, name in enumerate(TREND_FAMILIES)]
    return _first_match(rules, F.lit(len(TREND_FAMILIES)))
