from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.functions import labels as L
from meterlake.functions import models as M
from meterlake.operators.bins import choose_bin_size
from meterlake.operators.windows import (
    day_window,
    multi_day_window,
    prior_window,
    rolling_window,
    week_window,
)
from meterlake.sources.freshness import cache_is_fresh


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_day_and_week_windows():
    b = day_window("2026-08-01", "Pacific/Honolulu")
    assert b.start == datetime(2026, 8, 1, 10, tzinfo=UTC)
    assert b.end == datetime(2026, 8, 2, 10, tzinfo=UTC)
    w = week_window("2026-08-03", "Pacific/Honolulu")
    assert (w.start, w.end) == (
        datetime(2026, 7, 28, 10, tzinfo=UTC), datetime(2026, 8, 4, 10, tzinfo=UTC))
    assert prior_window(w).end == w.start
    assert prior_window(w).days == 7


def test_rolling_window_and_refusals():
    now = datetime(2026, 8, 20, tzinfo=UTC)
    assert rolling_window(now, 3).start == datetime(2026, 8, 17, tzinfo=UTC)
    for bad in (0, 3651):
        with pytest.raises(ValueError):
            rolling_window(now, bad)
    for bad in ("2026-02-30", "2026-2-3", "soon"):
        with pytest.raises(ValueError):
            day_window(bad, "UTC")
    with pytest.raises(ValueError):
        multi_day_window("2026-01-01", "Nowhere/Land", 3)


def test_bin_sizes():
    assert choose_bin_size(30, 96) == 3
    assert choose_bin_size(30, 120) == 2
    assert choose_bin_size(30, 120, prefer_daily=True) == 1
    assert choose_bin_size(3650, 100) == 37


def test_fresh_for_less_than_an_hour():
    at = datetime(2026, 8, 1, 12, tzinfo=UTC)
    assert cache_is_fresh(at, datetime(2026, 8, 1, 12, 59, 59, tzinfo=UTC))
    assert not cache_is_fresh(at, datetime(2026, 8, 1, 13, tzinfo=UTC))
    assert not cache_is_fresh(at, datetime(2026, 8, 1, 11, tzinfo=UTC))


def test_prices(spark):
    def price(model, i, c, o):
        return M.credits(F.lit(model), F.lit(i), F.lit(c), F.lit(o), F.lit(i + o))

    r = one(spark, price("gpt-5.6-luna", 1_000_000, 0, 1_000_000),
            price("gpt-5.4 mini", 90, 90, 10), price("lab", 1, 0, 1),
            M.normalize_model(F.lit(" GPT-5.5_Cyber x ")), M.normalize_model(F.lit("My Model")))
    assert r[0] == 35
    assert r[1] == pytest.approx(0.00129875)
    assert r[2] is None
    assert r[3] == "gpt-5.5-cyber"
    assert r[4] == "my-model"


def test_redaction(spark):
    unc, slashes = "\\\\server\\share\\private\\snapshot.json", "//server/share/private/snapshot.json"
    r = one(
        spark,
        L.redact_paths(F.lit(f'unc={unc}; normalized="{slashes}"')),
        L.redact_paths(F.lit("missing " + unc), [unc]),
        L.redact_paths(F.lit(f"url=https://registry.example.org/sharp; unc={slashes}")),
        L.redact_title(F.lit("see /Users/me/x and /private/tmp/y sk-abcdefghijklmnopqrst")),
    )
    assert r[0] == 'unc=[local path]; normalized="[local path]"'
    assert r[1] == "missing snapshot.json"
    assert r[2] == "url=https://registry.example.org/sharp; unc=[local path]"
    assert r[3] == "see [local path] and [temporary path] [redacted credential-like text]"


def test_labels(spark):
    none = F.lit(None).cast("string")
    r = one(
        spark,
        L.project_label(F.lit("/x/y"), F.lit("git@host.example:team/repo.git")),
        L.project_label(F.lit("/home/u/.codex/worktrees/ab/name"), none),
        L.project_label(F.lit(""), none),
        L.short_label(F.lit("a" * 20 + "b" * 20)),
        L.usage_type_label(F.lit("api_tool-call")),
        L.safe_title(none, none, none, F.lit("subagent"), none, none, F.lit("123456789")),
        L.source_labels(none, F.lit('{"subagent":"x"}')),
        L.clean_label(F.lit("\x1b[31mred\x1b[0m\t\n x"), "none"),
        L.project_label(F.lit("/x/y"), F.lit("work:crew/repo.git")),
        L.project_label(F.lit("/x/y"), F.lit("https://host.example:8443/team/repo.git?x=1")),
    )
    assert r[0] == "team/repo"
    assert r[1] == "name"
    assert r[2] == "Unknown project"
    assert r[3] == "a" * 14 + "…" + "b" * 13
    assert r[4] == "API Tool Call"
    assert r[5] == "Subagent · 12345678"
    assert tuple(r[6]) == ("subagent", "subagent")
    assert r[7] == "red x"
    assert (r[8], r[9]) == ("crew/repo", "team/repo")
