"""Registered queries and their SQL, name by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import logs, readers
from checks import sample as S
from meterlake.functions import labels as L
from meterlake.functions import models as M
from meterlake.operators import bins as B
from meterlake.operators import burn as burning
from meterlake.operators import context as C
from meterlake.operators import dedupe as D
from meterlake.operators import display, meter
from meterlake.operators import projects as P
from meterlake.operators.windows import (
    day_window,
    in_window,
    prior_window,
    rolling_window,
)
from meterlake.plans import ingest, report
from meterlake.sources.metadata import TITLES_SCHEMA, thread_state
from meterlake.sources.rollouts import lines_from_table
from meterlake.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEEK, TREND = S.WEEK, S.TREND
DAY = day_window("2024-01-17", S.TZ)
ROLLING = rolling_window(datetime(2024, 1, 20, 12, tzinfo=UTC), 3)
GENERATED = datetime(2024, 1, 26, 15, 30, tzinfo=UTC)


def _q(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _day(*names: str) -> list:
    return [F.col(n).cast("string").alias(n) for n in names]


def _ms(name: str, out: str):
    return F.unix_millis(name).alias(out)


def _within(b, c: str = "ts") -> str:
    return f"epoch_ms({c}) >= {b.start_ms} AND epoch_ms({c}) < {b.end_ms}"


def _week_events(spark, d):
    return in_window(S.ledger_events(spark, d), WEEK)


# ---- Projects and the dashboard -------------------------------------------------------------

_SINGLES = f"""WITH {S.SQL_EVENTS}, {S.SQL_THREADS},
sg AS (SELECT account_id, project FROM (
         SELECT account_id, project, thread_id FROM ev UNION ALL
         SELECT account_id, project, id FROM thr)
       GROUP BY ALL HAVING count(DISTINCT thread_id) = 1)"""


def _project_sql(b, extra: str = "", tail: str = "") -> str:
    return f"""{_SINGLES},
us AS (
  SELECT e.account_id,
         CASE WHEN sg.project IS NULL THEN e.project ELSE 'Other activity' END AS project,
         CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
         CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
         CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
         CAST(sum(tool_calls) AS BIGINT) AS tool_calls, count(*) AS events,
         count(DISTINCT thread_id) AS threads,
         round(coalesce(sum(stored), 0), 6) AS rate_card_credits,
         CAST(coalesce(sum(CASE WHEN stored IS NOT NULL THEN total_tokens END), 0) AS BIGINT)
           AS known_credit_tokens
  FROM ev e LEFT JOIN sg USING (account_id, project) WHERE {_within(b)}
  GROUP BY 1, 2){extra}
{tail}"""


def _projects(spark, d, b):
    events = S.ledger_events(spark, d)
    singles = P.singleton_projects(events, S.ledger_threads(spark, d))
    return P.project_usage(in_window(events, b), singles)


_USAGE = ["account_id", "project", "total_tokens", "output_tokens", "reasoning_tokens",
          "tool_calls", "events", "threads", "known_credit_tokens"]


@_q("top_projects_week", _project_sql(WEEK, tail="""
SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_tokens DESC, project) AS rank
FROM us QUALIFY rank <= 5"""))
def _(spark, d):
    return P.top_projects(_projects(spark, d, WEEK), 5).select(
        *_USAGE, "rank", *_r("rate_card_credits"))


@_q("project_usage_day", _project_sql(DAY, tail="SELECT * FROM us"))
def _(spark, d):
    return _projects(spark, d, DAY).select(*_USAGE, *_r("rate_card_credits"))


@_q("project_usage_rolling", _project_sql(ROLLING, tail="""
SELECT account_id, project, total_tokens,
       round(100.0 * total_tokens / sum(total_tokens) OVER w, 6) AS share,
       round(100.0 * rate_card_credits / sum(rate_card_credits) OVER w, 6) AS credit_share
FROM us WINDOW w AS (PARTITION BY account_id)"""))
def _(spark, d):
    return P.with_share(_projects(spark, d, ROLLING)).select(
        "account_id", "project", "total_tokens", *_r("share", "credit_share"))


@_q("project_model_mix", f"""{_SINGLES},
mx AS (
  SELECT e.account_id,
         CASE WHEN sg.project IS NULL THEN e.project ELSE 'Other activity' END AS project,
         CASE WHEN family IN ('Luna', 'Sol', 'GPT-5.5') THEN family ELSE model END AS model,
         CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS events,
         round(coalesce(sum(stored), 0), 6) AS rate_card_credits
  FROM ev e LEFT JOIN sg USING (account_id, project) WHERE {_within(WEEK)} GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (w ORDER BY total_tokens DESC, model) AS rank,
       round(CASE WHEN sum(total_tokens) OVER w > 0
         THEN 100.0 * total_tokens / sum(total_tokens) OVER w ELSE 0 END, 6) AS share
FROM mx WINDOW w AS (PARTITION BY account_id, project) QUALIFY rank <= 4""")
def _(spark, d):
    events = S.ledger_events(spark, d)
    singles = P.singleton_projects(events, S.ledger_threads(spark, d))
    mix = P.project_model_mix(in_window(events, WEEK), singles)
    return P.top_models(mix).select(
        "account_id", "project", "model", "total_tokens", "events", "rank",
        *_r("rate_card_credits", "share"))


@_q("singleton_projects", f"{_SINGLES} SELECT * FROM sg")
def _(spark, d):
    return P.singleton_projects(S.ledger_events(spark, d), S.ledger_threads(spark, d))


@_q("usage_summary", f"""WITH {S.SQL_EVENTS}
SELECT account_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(tool_calls) AS BIGINT) AS tool_calls,
       CAST(sum(least(input_tokens, cached_input_tokens)) AS BIGINT) AS cached_input_tokens,
       CAST(sum(input_tokens) - sum(least(input_tokens, cached_input_tokens)) AS BIGINT)
         AS uncached_input_tokens,
       count(*) AS calls, count(DISTINCT thread_id) AS threads,
       round(sum(stored), 6) AS rate_card_credits,
       CAST(sum(CASE WHEN stored IS NOT NULL THEN total_tokens END) AS BIGINT)
         AS known_credit_tokens
FROM ev WHERE {_within(WEEK)} GROUP BY 1""")
def _(spark, d):
    s = P.usage_summary(_week_events(spark, d))
    return s.withColumn("rate_card_credits", F.round("rate_card_credits", 6))


@_q("model_totals", f"""WITH {S.SQL_EVENTS}, fam AS (
  SELECT * FROM (VALUES ('Luna', 0), ('Sol', 1), ('Terra', 2), ('GPT', 3), ('Other', 4))
    f(model, position)),
w AS (SELECT account_id, total_tokens, CASE family WHEN 'GPT-5.5' THEN 'GPT'
        ELSE CASE WHEN model = 'GPT-5.4 mini' THEN 'GPT' ELSE family END END AS model
      FROM ev WHERE {_within(WEEK)}),
t AS (SELECT account_id, sum(total_tokens) AS all_tokens FROM w GROUP BY 1)
SELECT t.account_id, fam.model, fam.position,
       CAST(coalesce(sum(w.total_tokens), 0) AS BIGINT) AS total_tokens,
       round(100.0 * coalesce(sum(w.total_tokens), 0) / any_value(t.all_tokens), 6) AS share
FROM t CROSS JOIN fam LEFT JOIN w ON w.account_id = t.account_id AND w.model = fam.model
GROUP BY 1, 2, 3""")
def _(spark, d):
    return P.model_totals(_week_events(spark, d)).withColumn("share", F.round("share", 6))


@_q("usage_types_folded", f"""WITH {S.SQL_EVENTS},
u AS (SELECT account_id, use_type, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ev
      WHERE {_within(WEEK)} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_tokens DESC, use_type)
        AS rank, count(*) OVER (PARTITION BY account_id) AS n FROM u)
SELECT account_id, use_type, upper(use_type[1]) || replace(use_type[2:], '_', ' ') AS label,
       total_tokens, rank FROM r WHERE n <= 5 OR rank <= 4
UNION ALL
SELECT account_id, 'other', 'Other', CAST(sum(total_tokens) AS BIGINT), 5 FROM r
WHERE n > 5 AND rank > 4 GROUP BY 1""")
def _(spark, d):
    return P.fold_tail(P.usage_types(_week_events(spark, d)), "use_type")


@_q("cache_coverage", f"""WITH {S.SQL_EVENTS},
s AS (SELECT account_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
             CAST(sum(least(input_tokens, cached_input_tokens)) AS BIGINT) AS cached_input_tokens
      FROM ev WHERE {_within(WEEK)} GROUP BY 1)
SELECT *, input_tokens - cached_input_tokens AS uncached_input_tokens,
       round(100.0 * cached_input_tokens / input_tokens, 6) AS cached_share,
       round(100.0 * (input_tokens - cached_input_tokens) / input_tokens, 6) AS uncached_share
FROM s""")
def _(spark, d):
    c = P.cache_coverage(_week_events(spark, d))
    return c.select("account_id", "input_tokens", "cached_input_tokens", "uncached_input_tokens",
                    *_r("cached_share", "uncached_share"))


@_q("credits_by_model", f"""WITH {S.SQL_EVENTS},
m AS (SELECT account_id, model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
             coalesce(sum(credits), 0) AS c FROM ev WHERE {_within(WEEK)} GROUP BY 1, 2)
SELECT account_id, model, total_tokens, round(c, 6) AS rate_card_credits,
       round(100.0 * total_tokens / sum(total_tokens) OVER w, 6) AS share,
       round(100.0 * c / sum(c) OVER w, 6) AS credit_share
FROM m WINDOW w AS (PARTITION BY account_id)""")
def _(spark, d):
    return P.credits_by_model(_week_events(spark, d)).select(
        "account_id", "model", "total_tokens", *_r("rate_card_credits", "share", "credit_share"))


@_q("rate_summary", f"""WITH {S.SQL_EVENTS}
SELECT account_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(CASE WHEN credits IS NOT NULL THEN total_tokens ELSE 0 END) AS BIGINT)
         AS rated_tokens,
       round(coalesce(sum(credits), 0), 6) AS credits,
       round(coalesce(sum(CASE WHEN service_tier = 'priority' THEN credits END), 0), 6)
         AS priority_credits,
       round(100.0 * sum(CASE WHEN credits IS NOT NULL THEN total_tokens ELSE 0 END)
         / sum(total_tokens), 6) AS coverage_percent
FROM ev WHERE {_within(TREND)} GROUP BY 1""")
def _(spark, d):
    return P.rate_summary(in_window(S.ledger_events(spark, d), TREND)).select(
        "account_id", "total_tokens", "rated_tokens",
        *_r("credits", "priority_credits", "coverage_percent"))


@_q("event_credits", f"""WITH {S.SQL_EVENTS}
SELECT account_id, id, round(credits, 6) AS credits FROM ev""")
def _(spark, d):
    return S.ledger_events(spark, d).select(
        "account_id", "id", F.round(M.event_credits(), 6).alias("credits"))


@_q("model_families", f"""WITH {S.SQL_EVENTS}
SELECT model,
       CASE model WHEN 'GPT-5.4 mini' THEN 'gpt-5.4-mini' WHEN 'lab_model' THEN 'lab-model'
         ELSE model END AS canonical,
       CASE WHEN family IN ('Luna', 'Sol', 'GPT-5.5') THEN family ELSE model END AS project_family,
       CASE model WHEN 'gpt-5.5' THEN 'GPT' WHEN 'GPT-5.4 mini' THEN 'GPT'
         ELSE family END AS dashboard_family,
       family AS trend_family, count(*) AS n FROM ev GROUP BY ALL""")
def _(spark, d):
    m = F.col("model")
    return S.ledger_events(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", "n", M.normalize_model(m).alias("canonical"),
        M.project_family(m).alias("project_family"),
        M.dashboard_family(m).alias("dashboard_family"), M.trend_family(m).alias("trend_family"))


@_q("project_totals_plain", f"""WITH {S.SQL_EVENTS}
SELECT account_id, project, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ev
WHERE {_within(TREND)} AND total_tokens > 0 GROUP BY 1, 2""")
def _(spark, d):
    return P.project_totals_plain(in_window(S.ledger_events(spark, d), TREND))


# ---- Token columns and report tables --------------------------------------------------------

def _bins_cte(b, size: int = 1, name: str = "tb") -> str:
    return f"""{name} AS (
  SELECT account_id, (day - DATE '{b.first_day}') // {size} AS bin, family AS model,
         CAST(sum(total_tokens) AS BIGINT) AS tokens,
         CAST(sum(CASE WHEN service_tier = 'priority' THEN total_tokens ELSE 0 END) AS BIGINT)
           AS fast_tokens, count(*) AS calls
  FROM ev WHERE {_within(b)} GROUP BY 1, 2, 3)"""


def _bin_days(b, size: int) -> str:
    return (f"CAST(DATE '{b.first_day}' + CAST(bin * {size} AS INTEGER) AS VARCHAR) AS start_day, "
            f"CAST(DATE '{b.first_day}' + CAST(least({b.days}, (bin + 1) * {size}) AS INTEGER) "
            "AS VARCHAR) AS end_day")


@_q("token_bins_daily", f"""WITH {S.SQL_EVENTS}, {_bins_cte(TREND)}
SELECT account_id, bin, {_bin_days(TREND, 1)}, model, tokens, fast_tokens, calls FROM tb""")
def _(spark, d):
    return B.token_bins(S.ledger_events(spark, d), TREND).select(
        "account_id", "bin", *_day("start_day", "end_day"), "model", "tokens", "fast_tokens",
        "calls")


@_q("token_bins_3day", f"""WITH {S.SQL_EVENTS}, {_bins_cte(TREND, 3)},
sp AS (SELECT account_id, bin FROM (SELECT DISTINCT account_id FROM tb),
       unnest(generate_series(0, 4)) g(bin))
SELECT account_id, bin, {_bin_days(TREND, 3)},
       CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
       CAST(coalesce(sum(fast_tokens), 0) AS BIGINT) AS fast_tokens,
       CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls
FROM sp LEFT JOIN tb USING (account_id, bin) GROUP BY 1, 2""")
def _(spark, d):
    bins = B.token_bins(S.ledger_events(spark, d), TREND, 3)
    return B.bin_totals(bins, TREND, 3).select(
        "account_id", "bin", *_day("start_day", "end_day"), "tokens", "fast_tokens", "calls")


_PRIOR = prior_window(WEEK)


@_q("prior_period_delta", f"""WITH {S.SQL_EVENTS}, {_bins_cte(WEEK)},
{_bins_cte(_PRIOR, 1, 'pb')},
c AS (SELECT account_id, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM tb GROUP BY 1, 2),
p AS (SELECT account_id, model, CAST(sum(tokens) AS BIGINT) AS pt FROM pb GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(pt, 0) AS prior_tokens,
             CASE WHEN pt >= 1000000 THEN tokens / pt::DOUBLE END AS q
      FROM c LEFT JOIN p USING (account_id, model))
SELECT account_id, model, tokens, prior_tokens, round(q, 6) AS ratio,
       round((q - 1) * 100, 6) AS delta_percent,
       CASE WHEN q >= 5 THEN 'ratio' WHEN q IS NOT NULL THEN 'percent' END AS shown_as FROM j""")
def _(spark, d):
    ev = S.ledger_events(spark, d)
    now = B.family_totals(B.token_bins(ev, WEEK))
    before = B.family_totals(B.token_bins(ev, _PRIOR))
    return B.period_delta(now, before).select(
        "account_id", "model", "tokens", "prior_tokens", *_r("ratio", "delta_percent"),
        "shown_as")


@_q("priority_share", f"""WITH {S.SQL_EVENTS}, {_bins_cte(TREND)}
SELECT account_id, model, CAST(sum(tokens) AS BIGINT) AS tokens,
       CAST(sum(fast_tokens) AS BIGINT) AS fast_tokens,
       round(100.0 * sum(fast_tokens) / sum(tokens), 6) AS fast_share
FROM tb GROUP BY GROUPING SETS ((account_id, model), (account_id))""")
def _(spark, d):
    return B.fast_share(B.token_bins(S.ledger_events(spark, d), TREND)).withColumn(
        "fast_share", F.round("fast_share", 6))


@_q("model_cards", f"""WITH {S.SQL_EVENTS}, {_bins_cte(TREND)},
f AS (SELECT account_id, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM tb GROUP BY 1, 2),
s AS (SELECT *, tokens / sum(tokens) OVER (PARTITION BY account_id) AS q FROM f)
SELECT account_id, model, tokens, round(q * 100, 6) AS share,
       row_number() OVER (PARTITION BY account_id ORDER BY tokens DESC, model) AS rank
FROM s WHERE tokens > 0 AND q >= 0.01 QUALIFY rank <= 3""")
def _(spark, d):
    return B.model_cards(B.token_bins(S.ledger_events(spark, d), TREND)).withColumn(
        "share", F.round("share", 6))


@_q("top_with_rest", _project_sql(TREND, extra=""",
rk AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_tokens DESC, project)
         AS rank, count(*) OVER (PARTITION BY account_id) AS projects,
         sum(total_tokens) OVER (PARTITION BY account_id) AS all_tokens FROM us),
sh AS (SELECT *, round(100.0 * sum(CASE WHEN rank <= 3 THEN total_tokens END)
         OVER (PARTITION BY account_id) / all_tokens, 6) AS top_share FROM rk)""", tail="""
SELECT account_id, rank, project AS name, total_tokens AS tokens, false AS is_rest, projects,
       top_share FROM sh WHERE rank <= 3
UNION ALL
SELECT account_id, 4, CASE WHEN count(*) = 1 THEN any_value(project)
         ELSE count(*) || ' other projects' END,
       CAST(sum(total_tokens) AS BIGINT), true, any_value(projects), any_value(top_share)
FROM sh WHERE rank > 3 GROUP BY 1"""))
def _(spark, d):
    return B.top_with_rest(_projects(spark, d, TREND)).withColumn(
        "top_share", F.round("top_share", 6))


# ---- The meter ------------------------------------------------------------------------------

_TL = f"WITH {S.SQL_EVENTS}, {S.SQL_QUOTA}, {S.SQL_TIMELINE}"


def _timeline(spark, d):
    return meter.timeline(S.quota_observations(spark, d))


@_q("weekly_observations", f"""{_TL}
SELECT account_id, event_id, ms, used AS used_percent, resets_at FROM ma""")
def _(spark, d):
    obs = meter.select_meter(meter.weekly_observations(S.quota_observations(spark, d)))
    return obs.select("account_id", F.col("seen.ord").alias("event_id"), _ms("ts", "ms"),
                      "used_percent", "resets_at")


@_q("meter_timeline", f"""{_TL}
SELECT account_id, event_id, ms, resets_at, used AS used_percent, norm AS normalized, cycle, reset,
       kind AS reset_kind, cycle_ms FROM tl""")
def _(spark, d):
    return _timeline(spark, d).select(
        "account_id", F.col("seen.ord").alias("event_id"), _ms("ts", "ms"), "resets_at",
        "used_percent", F.col("normalized_used_percent").alias("normalized"), "cycle", "reset",
        "reset_kind", _ms("cycle_start_ts", "cycle_ms"))


@_q("cycle_list", f"""{_TL}
SELECT account_id, cycle, n, top AS epoch_resets_at, first_ms, last_ms FROM ce""")
def _(spark, d):
    obs = meter.select_meter(meter.weekly_observations(S.quota_observations(spark, d)))
    return meter.cycles(meter.epoch_table(meter.assign_epochs(obs))).select(
        "account_id", "cycle", "n", "epoch_resets_at", _ms("first_ts", "first_ms"),
        _ms("last_ts", "last_ms"))


@_q("chained_windows", f"""WITH RECURSIVE {S.SQL_EVENTS},
o AS (
  SELECT account_id, event_id, resets_at,
         row_number() OVER (PARTITION BY account_id ORDER BY ms, resets_at, event_id) AS i
  FROM (SELECT 'a' || (user_id % 3) AS account_id, event_id, epoch_ms(ts) AS ms,
               1705000000 + ((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 3600) * 20
                 + (event_id * 7919) % 1301 AS resets_at
        FROM raw WHERE event_type = 'view')),
walk AS (
  SELECT account_id, 0::BIGINT AS i, 0::BIGINT AS event_id, []::BIGINT[] AS opened,
         []::BIGINT[] AS firsts, 0::BIGINT AS first_event_id FROM o WHERE o.i = 1
  UNION ALL
  SELECT account_id, i, event_id,
         CASE WHEN hit IS NULL THEN list_append(opened, resets_at)
              ELSE list_transform(opened, lambda v, k: CASE WHEN k = hit THEN greatest(v, resets_at) ELSE v END) END,
         CASE WHEN hit IS NULL THEN list_append(firsts, event_id) ELSE firsts END,
         CASE WHEN hit IS NULL THEN event_id ELSE firsts[hit] END
  FROM (SELECT w.account_id, o.i, o.event_id, o.resets_at, opened, firsts,
               nullif(list_position(list_transform(opened, lambda v: abs(v - o.resets_at) <= 300), true), 0) AS hit
        FROM walk w JOIN o ON o.account_id = w.account_id AND o.i = w.i + 1))
SELECT account_id, event_id, first_event_id FROM walk WHERE i > 0""")
def _(spark, d):
    """Windows of chained reset times; small chunks, so that they are worked on in many tasks."""
    placed = meter.assign_epochs(S.drifting_quota(spark, d), chunk_rows=300)
    first = F.min_by("seen.ord", F.struct(*meter.ORDER)).over(Window.partitionBy("account_id", "cluster", "part"))
    return placed.select("account_id", F.col("seen.ord").alias("event_id"), first.alias("first_event_id"))


_RESETS = f"""rs AS (
  SELECT account_id, cycle, cycle_ms, ms AS observed_ms, kind FROM tl
  WHERE reset AND ms < {TREND.end_ms} AND cycle_ms >= {TREND.start_ms}
    AND cycle_ms < {TREND.end_ms})"""


@_q("resets", f"{_TL}, {_RESETS} SELECT * FROM rs")
def _(spark, d):
    return display.resets(_timeline(spark, d), TREND).select(
        "account_id", "cycle", _ms("ts", "cycle_ms"), _ms("observed_at", "observed_ms"), "kind")


@_q("current_meter", f"""{_TL}
SELECT account_id, event_id, ms, norm AS normalized FROM tl QUALIFY row_number() OVER (
  PARTITION BY account_id ORDER BY cycle DESC, ms DESC, resets_at DESC, event_id DESC) = 1""")
def _(spark, d):
    return meter.current_meter(_timeline(spark, d)).select(
        "account_id", F.col("seen.ord").alias("event_id"), _ms("ts", "ms"),
        F.col("normalized_used_percent").alias("normalized"))


_LAST_DAYS = rolling_window(datetime(2024, 2, 1, tzinfo=UTC), 4)


@_q("quota_cycle", f"""{_TL},
cm AS (SELECT *, resets_at * 1000 AS reset_ms FROM tl QUALIFY row_number() OVER (
  PARTITION BY account_id ORDER BY cycle DESC, ms DESC, resets_at DESC, event_id DESC) = 1),
s AS (
  SELECT cm.account_id, any_value(cm.norm) AS used_percent,
    CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS cycle_tokens,
    CAST(coalesce(sum(CASE WHEN {_within(_LAST_DAYS)} THEN total_tokens END), 0) AS BIGINT)
      AS displayed_tokens,
    sum(credits) AS cc, sum(CASE WHEN {_within(_LAST_DAYS)} THEN credits END) AS dc,
    sum(CASE WHEN credits IS NOT NULL THEN total_tokens END) AS rated
  FROM cm LEFT JOIN ev e ON e.account_id = cm.account_id
    AND epoch_ms(e.ts) >= reset_ms - 604800000 AND epoch_ms(e.ts) <= least(reset_ms, ms)
  GROUP BY 1),
q AS (SELECT *, CASE WHEN rated = cycle_tokens AND cc > 0 THEN 100.0 * dc / cc
        WHEN cycle_tokens > 0 THEN 100.0 * displayed_tokens / cycle_tokens END AS sh FROM s)
SELECT account_id, used_percent, 100 - used_percent AS remaining_percent, cycle_tokens,
       displayed_tokens, round(sh, 6) AS displayed_share_percent,
       CASE WHEN rated = cycle_tokens AND cc > 0 THEN 'credits' ELSE 'tokens' END AS share_basis,
       round(used_percent * sh / 100, 6) AS estimated_displayed_burn_percent FROM q""")
def _(spark, d):
    c = display.quota_cycle(_timeline(spark, d), S.ledger_events(spark, d), _LAST_DAYS)
    return c.select(
        "account_id", "used_percent", "remaining_percent", "cycle_tokens", "displayed_tokens",
        "share_basis", *_r("displayed_share_percent", "estimated_displayed_burn_percent"))


# ---- Burn -----------------------------------------------------------------------------------

_BURN = f"{_TL}, {S.sql_burn(TREND.end_ms)}"


def _spans(spark, d):
    return burning.burn(_timeline(spark, d), S.ledger_events(spark, d), TREND)


@_q("burn_intervals", f"""{_BURN}
SELECT account_id, cycle, norm AS used_percent, start_ms, end_ms, points,
       end_ms - start_ms > 129600000 AS spans_long_gap FROM sp""")
def _(spark, d):
    return burning.burn_intervals(_timeline(spark, d), TREND).select(
        "account_id", "cycle", "used_percent", _ms("start_ts", "start_ms"),
        _ms("end_ts", "end_ms"), "points", "spans_long_gap")


@_q("burn_by_model", f"""{_BURN}
SELECT account_id, cycle, norm AS used_percent, model, round(model_points, 6) AS model_points,
       model_tokens, method FROM co""")
def _(spark, d):
    return burning.burn_by_model(_spans(spark, d)).select(
        "account_id", "cycle", "used_percent", "model", *_r("model_points"), "model_tokens",
        "method")


@_q("burn_day_shares", f"""{_BURN}
SELECT account_id, cycle, norm AS used_percent, CAST(day AS VARCHAR) AS day,
       round(share, 6) AS share FROM ds""")
def _(spark, d):
    return burning.burn_day_shares(_spans(spark, d)).select(
        "account_id", "cycle", "used_percent", *_day("day"), *_r("share"))


_BURN_BINS = f"""bb0 AS (
  SELECT co.account_id, (ds.day - DATE '{TREND.first_day}') // 2 AS bin, co.model,
         co.model_points * ds.share AS pts, co.end_ms - co.start_ms > 129600000 AS lg
  FROM co JOIN ds ON co.account_id = ds.account_id AND co.cycle = ds.cycle AND co.norm = ds.norm
  WHERE co.end_ms >= {TREND.start_ms} AND co.end_ms < {TREND.end_ms}
    AND ds.day BETWEEN DATE '{TREND.first_day}' AND DATE '{TREND.last_day}'),
bb AS (
  SELECT account_id, bin, model, sum(pts) AS pts,
         bool_or(bool_or(lg)) OVER (PARTITION BY account_id, bin) AS approximate
  FROM bb0 GROUP BY 1, 2, 3)"""


@_q("burn_day_bins", f"""{_BURN}, {_BURN_BINS}
SELECT account_id, bin, {_bin_days(TREND, 2)}, model, round(pts, 6) AS points, approximate
FROM bb WHERE pts > 0""")
def _(spark, d):
    return burning.burn_bins(_spans(spark, d), TREND, 2).select(
        "account_id", "bin", *_day("start_day", "end_day"), "model", *_r("points"), "approximate")


_STATS = f"""dv AS (SELECT * FROM ev WHERE {_within(TREND)}),
ef AS (SELECT account_id, family, effort, sum(total_tokens) AS t,
              min(epoch_ms(ts)::HUGEINT * 100000000 + event_id) AS f
       FROM dv GROUP BY 1, 2, 3),
te AS (SELECT * FROM ef QUALIFY row_number() OVER (
         PARTITION BY account_id, family ORDER BY t DESC, f) = 1),
us AS (SELECT account_id, family AS model, sum(total_tokens) AS tokens, sum(credits) AS c,
              sum(CASE WHEN credits IS NOT NULL THEN total_tokens ELSE 0 END) AS rated
       FROM dv GROUP BY 1, 2),
bu AS (SELECT account_id, model, sum(model_points) AS p, sum(model_tokens) AS a FROM co
       WHERE end_ms >= {TREND.start_ms} AND end_ms < {TREND.end_ms} GROUP BY 1, 2),
ms AS (
  SELECT account_id, model, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens,
         round(coalesce(c, 0), 6) AS credits, CAST(coalesce(rated, 0) AS BIGINT) AS rated_tokens,
         CAST(coalesce(a, 0) AS BIGINT) AS attributed_tokens,
         round(coalesce(p, 0), 6) AS burn_points, coalesce(te.effort, 'unknown') AS dominant_effort,
         round(CASE WHEN tokens > 0 THEN te.t / tokens ELSE 0 END, 6) AS dominant_effort_share,
         round(CASE WHEN p > 0 AND a > 0 THEN a / p END, 4) AS tokens_per_burn_point,
         round(CASE WHEN tokens > 0 THEN 100.0 * rated / tokens END, 6) AS rated_percent
  FROM us FULL JOIN bu USING (account_id, model)
  LEFT JOIN te ON te.account_id = us.account_id AND te.family = us.model)"""


def _trend(spark, d):
    return report.usage_trend(S.ledger_events(spark, d), S.quota_observations(spark, d), TREND)


@_q("model_stats", f"{_BURN}, {_STATS} SELECT * FROM ms")
def _(spark, d):
    return _trend(spark, d).models.select(
        "account_id", "model", "tokens", "rated_tokens", "attributed_tokens", "dominant_effort",
        *_r("credits", "burn_points", "dominant_effort_share", "rated_percent"),
        F.round("tokens_per_burn_point", 4).alias("tokens_per_burn_point"))


@_q("burn_rates", f"""{_BURN}, {_STATS}
SELECT account_id, model, tokens_per_burn_point, burn_points FROM ms
WHERE tokens_per_burn_point > 0 AND model IN ('Luna', 'Sol')""")
def _(spark, d):
    return B.burn_rates(_trend(spark, d).models).select(
        "account_id", "model", F.round("tokens_per_burn_point", 4).alias("tokens_per_burn_point"),
        *_r("burn_points"))


_POINTS = f"""
pt AS (SELECT account_id, cycle, ms, resets_at, event_id, norm, 100 - norm AS remaining FROM tl
       WHERE ms < {TREND.end_ms}),
lp AS (SELECT * FROM pt QUALIFY row_number() OVER (
         PARTITION BY account_id ORDER BY cycle DESC, ms DESC, resets_at DESC, event_id DESC) = 1),
bf AS (SELECT * FROM pt WHERE ms <= {TREND.start_ms} QUALIFY row_number() OVER (
         PARTITION BY account_id ORDER BY cycle DESC, ms DESC, resets_at DESC, event_id DESC) = 1),
dp AS (
  SELECT account_id, cycle, {TREND.start_ms} AS ms, resets_at, event_id, norm, remaining,
         ms = {TREND.start_ms} AS observed FROM bf
  UNION ALL SELECT *, true FROM pt WHERE ms > {TREND.start_ms}
  UNION ALL SELECT account_id, cycle, {TREND.end_ms}, resets_at, event_id, norm, remaining, false
            FROM lp)"""


@_q("display_points", f"""{_TL}, {_POINTS}
SELECT account_id, cycle, ms, norm AS used_percent, remaining AS remaining_percent, observed
FROM dp""")
def _(spark, d):
    return _trend(spark, d).points.select(
        "account_id", "cycle", _ms("ts", "ms"), "used_percent", "remaining_percent", "observed")


@_q("meter_points", f"""{_BURN},
al AS (
  SELECT st.account_id, st.event_id, st.cycle, co.model, sum(co.model_points) AS pts
  FROM st JOIN co ON co.account_id = st.account_id AND co.cycle = st.cycle AND co.norm <= st.norm
  GROUP BY 1, 2, 3, 4)
SELECT account_id, event_id, cycle, model, round(pts, 6) AS points FROM al""")
def _(spark, d):
    tl = _timeline(spark, d)
    points = burning.meter_points(tl, burning.burn(tl, S.ledger_events(spark, d), TREND), TREND)
    return points.select(
        "account_id", F.col("seen.ord").alias("event_id"), "cycle",
        F.explode("allocations").alias("model", "points")).withColumn(
            "points", F.round("points", 6))


@_q("meter_grid", f"""{_TL}, {_RESETS}, {_POINTS},
gr AS (SELECT account_id, i AS sample,
         CAST(floor({TREND.start_ms}::BIGINT * 1000
           + i * ({TREND.end_ms - TREND.start_ms} / 59.0::DOUBLE) * 1000) AS BIGINT) AS us
       FROM (SELECT DISTINCT account_id FROM dp), unnest(generate_series(0, 59)) g(i)),
lg AS (SELECT *, lag(us, 1, {TREND.start_ms - 1}::BIGINT * 1000)
         OVER (PARTITION BY account_id ORDER BY sample) AS prev FROM gr),
hit AS (SELECT lg.*, EXISTS (SELECT 1 FROM rs WHERE rs.account_id = lg.account_id
          AND cycle_ms * 1000 > lg.prev AND cycle_ms * 1000 <= lg.us) AS reset FROM lg)
SELECT h.account_id, h.sample, h.reset,
       CASE WHEN any_value(h.reset) THEN 100.0
            ELSE arg_max(dp.remaining, dp.ms * 1000 + dp.cycle) END AS remaining_percent
FROM hit h LEFT JOIN dp ON dp.account_id = h.account_id AND dp.ms * 1000 <= h.us
GROUP BY 1, 2, 3""")
def _(spark, d):
    t = _trend(spark, d)
    return display.resample_meter(t.points, t.resets, TREND, 60).select(
        "account_id", "sample", "reset", "remaining_percent")


@_q("bin_readings", f"""{_TL}, {_RESETS}, {_POINTS},
ob2 AS (SELECT *, CAST(epoch_ms(ms::BIGINT) - INTERVAL 10 HOUR AS DATE)
          - DATE '{TREND.first_day}' AS bin FROM dp
        WHERE observed AND ms >= {TREND.start_ms} AND ms < {TREND.end_ms}),
tk AS (SELECT DISTINCT account_id, CAST(epoch_ms(cycle_ms::BIGINT) - INTERVAL 10 HOUR AS DATE)
         - DATE '{TREND.first_day}' AS bin FROM rs)
SELECT account_id, bin, ms, remaining AS remaining_percent FROM ob2
WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.account_id = ob2.account_id AND tk.bin = ob2.bin)
QUALIFY row_number() OVER (PARTITION BY account_id, bin
  ORDER BY cycle DESC, ms DESC, resets_at DESC, event_id DESC) = 1""")
def _(spark, d):
    t = _trend(spark, d)
    return display.bin_readings(t.points, t.resets, TREND).select(
        "account_id", "bin", _ms("ts", "ms"), "remaining_percent")


_PACE = f"""{_BURN}, {_POINTS}, {_BURN_BINS},
tt AS (SELECT account_id, sum(total_tokens) AS total FROM ev WHERE {_within(TREND)} GROUP BY 1),
bt AS (SELECT account_id, sum(pts) AS burned FROM bb WHERE pts > 0 GROUP BY 1),
nx AS (SELECT account_id, resets_at FROM ma WHERE ms < {TREND.end_ms} QUALIFY row_number() OVER (
         PARTITION BY account_id ORDER BY ms DESC, resets_at DESC, event_id DESC) = 1),
pa AS (
  SELECT account_id, total, total / {TREND.days}.0::DOUBLE AS daily, total / burned AS per_point,
         burned, lp.remaining, nx.resets_at,
         (nx.resets_at * 1000 - {round(GENERATED.timestamp() * 1000)}) / 86400000.0::DOUBLE AS dtr
  FROM tt JOIN bt USING (account_id) JOIN lp USING (account_id) JOIN nx USING (account_id)),
pb AS (SELECT *, remaining / (daily / per_point) AS runway FROM pa)"""


@_q("pace", f"""{_PACE}
SELECT account_id, CAST(total AS BIGINT) AS total_tokens, round(daily, 4) AS daily_average,
       round(per_point, 4) AS tokens_per_point, round(daily / per_point, 6) AS burn_per_day,
       round(runway, 6) AS runway_days, round(dtr, 6) AS days_to_reset,
       round(CASE WHEN dtr > 0 THEN runway - dtr END, 6) AS headroom_days,
       CASE WHEN dtr <= 0 THEN NULL WHEN abs(runway - dtr) <= 1.5 THEN 'lands near the reset'
            WHEN runway > dtr THEN 'leaves headroom' ELSE 'runs out before the reset' END AS note
FROM pb""")
def _(spark, d):
    p = report.pace(_trend(spark, d), S.ledger_events(spark, d), GENERATED, 2)
    return p.select(
        "account_id", "total_tokens", F.round("daily_average", 4).alias("daily_average"),
        F.round("tokens_per_point", 4).alias("tokens_per_point"),
        *_r("burn_per_day", "runway_days", "days_to_reset", "headroom_days"), "note")


@_q("report_facts", f"""{_PACE}, {_RESETS},
rc AS (SELECT account_id, sum(CASE WHEN kind = 'weekly-expiry' THEN 1 ELSE 0 END) AS sched,
              sum(CASE WHEN kind = 'restart' THEN 1 ELSE 0 END) AS early,
              arg_max(cycle_ms, observed_ms) AS last_ms FROM rs GROUP BY 1),
cr AS (SELECT account_id, sum(credits) AS c FROM ev WHERE {_within(TREND)} GROUP BY 1)
SELECT account_id, round(burned, 6) AS points_burned, round(c, 6) AS estimated_credits,
       CAST(coalesce(sched, 0) AS BIGINT) AS scheduled_resets,
       CAST(coalesce(early, 0) AS BIGINT) AS early_resets, last_ms AS last_reset_ms,
       resets_at * 1000 AS next_reset_ms
FROM pb JOIN cr USING (account_id) LEFT JOIN rc USING (account_id)""")
def _(spark, d):
    f = report.report_facts(_trend(spark, d), S.ledger_events(spark, d), GENERATED, 2)
    return f.select(
        "account_id", *_r("points_burned", "estimated_credits"), "scheduled_resets",
        "early_resets", _ms("last_reset_at", "last_reset_ms"), _ms("next_reset_at",
                                                                   "next_reset_ms"))


@_q("usage_trend_summary", f"""{_BURN},
mt AS (SELECT account_id, bool_or(method = 'mixed') AS mx, bool_or(method = 'rate-card') AS rc,
              bool_or(method = 'tokens') AS tk, bool_or(method = 'unattributed') AS un
       FROM co WHERE end_ms >= {TREND.start_ms} GROUP BY 1)
SELECT st.account_id, count(*) FILTER (ms >= {TREND.start_ms}) AS sample_count,
       max(ms) AS observed_through_ms,
       any_value(CASE WHEN mx OR (rc AND tk) THEN 'mixed rate-card and token weights'
         WHEN rc THEN 'rate-card weights' WHEN tk THEN 'token weights'
         WHEN un THEN 'unattributed burn' ELSE 'unavailable' END
         || CASE WHEN un AND (mx OR rc OR tk) THEN ' with unattributed gaps' ELSE '' END)
         AS allocation_method
FROM st LEFT JOIN mt USING (account_id) GROUP BY 1""")
def _(spark, d):
    return _trend(spark, d).summary.select(
        "account_id", "sample_count", _ms("observed_through", "observed_through_ms"),
        "allocation_method")


@_q("trend_columns", f"""{_BURN}, {_BURN_BINS}
SELECT account_id, bin, model, round(pts, 6) AS value, 'meter points' AS unit FROM bb
WHERE pts > 0""")
def _(spark, d):
    return report.trend_columns(
        _trend(spark, d), S.ledger_events(spark, d), 2, drain=True
    ).select("account_id", "bin", "model", *_r("value"), "unit")


@_q("series_bars", f"""WITH {S.SQL_EVENTS}, {_bins_cte(WEEK)},
dy AS (SELECT account_id, bin,
         coalesce(sum(CASE WHEN model = 'Luna' THEN tokens END), 0) AS luna,
         coalesce(sum(CASE WHEN model = 'Sol' THEN tokens END), 0) AS sol,
         coalesce(sum(CASE WHEN model NOT IN ('Luna', 'Sol') THEN tokens END), 0) AS oth
       FROM tb GROUP BY 1, 2),
un AS (SELECT account_id, bin, 'Luna' AS m, luna AS v FROM dy
       UNION ALL SELECT account_id, bin, 'Sol', sol FROM dy
       UNION ALL SELECT account_id, bin, 'Other', oth FROM dy)
SELECT account_id, strftime(DATE '{WEEK.first_day}' + CAST(bin AS INTEGER), '%m-%d') || ' ' || m
         AS day_model, printf('%.3f', v / 1e9::DOUBLE) AS tokens_billion FROM un""")
def _(spark, d):
    ev = S.ledger_events(spark, d)
    t = report.usage_trend(ev, S.quota_observations(spark, d), WEEK)
    bars, _line = report.series_export(B.token_bins(ev, WEEK), t.points, t.resets, WEEK)
    return bars


@_q("series_meter", f"""{_TL}, {_RESETS}, {_POINTS},
nr AS (SELECT dp.*, EXISTS (SELECT 1 FROM rs WHERE rs.account_id = dp.account_id
         AND abs(observed_ms - dp.ms) < 60000) AS near FROM dp WHERE ms >= {TREND.start_ms}),
al AS (SELECT account_id, ms, cycle, near, remaining FROM nr
       UNION ALL SELECT account_id, ms, cycle, near, 100.0 FROM nr WHERE near)
SELECT account_id, ms, round(1.0::DOUBLE + (ms - {TREND.start_ms})
         / {TREND.end_ms - TREND.start_ms}.0::DOUBLE * 6, 6) AS x, remaining FROM al""")
def _(spark, d):
    ev = S.ledger_events(spark, d)
    t = _trend(spark, d)
    _bars, line = report.series_export(B.token_bins(ev, TREND), t.points, t.resets, TREND)
    return line.select("account_id", _ms("ts", "ms"), *_r("x"), "remaining")


# ---- Log records ----------------------------------------------------------------------------

_LOG = f"WITH {S.SQL_LOG}"


def _context(spark, d, rows_per_block: int = 2_000):
    lines = lines_from_table(materialize(S.log_lines(spark, d), "lines"), rows_per_block)
    return ingest.context_records(lines)


@_q("context_carry", f"""{_LOG}
SELECT account_id, file, event_id AS ord, kind, model, effort, cwd, tier AS service_tier, turn,
       original AS original_likely FROM cx""")
def _(spark, d):
    return _context(spark, d).select(
        "account_id", "file", "ord", "kind", "model", "effort", "cwd", "service_tier", "turn",
        "original_likely")


@_q("turn_origins", f"""{_LOG}
SELECT account_id, cand_turn AS turn, thread_id, delta AS delta_ms, model, effort, cwd,
       cand_tier AS service_tier FROM org""")
def _(spark, d):
    return D.turn_origins(C.turn_candidates(_context(spark, d))).select(
        "account_id", "turn", "origin.thread_id", "origin.delta_ms", "origin.model",
        "origin.effort", "origin.cwd", "origin.service_tier")


@_q("dedup_calls", f"""{_LOG}
SELECT account_id, turn, 'evt-' || substr(sha256(key), 1, 24) AS id, thread_id, ms, model, tier
         AS service_tier, original AS original_likely, copies, seen_file, seen_ord,
       CASE WHEN turn IS NULL THEN 'legacy-heuristic' ELSE 'turn-exact' END AS dedupe_quality
FROM calls""")
def _(spark, d):
    return D.dedupe_calls(C.token_records(_context(spark, d))).select(
        "account_id", "turn", "id", "thread_id", _ms("ts", "ms"), "model", "service_tier",
        "original_likely", "copies", F.col("seen.file").alias("seen_file"),
        F.col("seen.ord").alias("seen_ord"), "dedupe_quality")


@_q("counter_corrections", f"""{_LOG}
SELECT account_id, file, CAST(sum(bad) AS BIGINT) AS parse_errors,
       CAST(sum(corr) AS BIGINT) AS correction_intervals FROM (
  SELECT account_id, file, 1 AS bad, 0 AS corr FROM cx WHERE kind = 'bad'
  UNION ALL SELECT account_id, file, 0, CASE WHEN total < counter_before THEN 1 ELSE 0 END FROM tok
  UNION ALL SELECT account_id, file, 0, 0 FROM cx WHERE kind = 'tokens')
GROUP BY 1, 2""")
def _(spark, d):
    return C.file_counters(_context(spark, d))


@_q("dedup_tools", f"""{_LOG},
tc AS (SELECT *, 'tool' || (k % 4) AS name,
         CASE WHEN k % 3 = 0 THEN 'function_call' ELSE 'custom_tool_call' END AS type,
         CASE WHEN k % 3 = 0 THEN 'c' || event_id END AS stable FROM cx WHERE kind = 'call'),
nu AS (SELECT *, row_number() OVER (PARTITION BY file, turn, type, name ORDER BY event_id) AS n
       FROM tc),
ky AS (SELECT *, CASE WHEN stable IS NOT NULL THEN 'id|' || stable
         ELSE 'ordinal|' || coalesce(turn, '') || '|' || type || '|' || name || '|' || n END AS key
       FROM nu)
SELECT account_id, key, coalesce(turn, '') AS turn, thread_id, original AS original_likely FROM ky
QUALIFY row_number() OVER (PARTITION BY account_id, key
  ORDER BY original DESC, file, event_id) = 1""")
def _(spark, d):
    return D.dedupe_tool_calls(C.call_records(_context(spark, d))).select(
        "account_id", "key", "turn", "thread_id", "original_likely")


@_q("dedup_quota", f"""{_LOG},
qr AS (SELECT *, k % 50 AS used, 1704067200 + (event_id % 4) * 604800 AS resets_at
       FROM cx WHERE kind = 'tokens' AND k % 2 = 0),
qw AS (SELECT * FROM qr QUALIFY row_number() OVER (PARTITION BY account_id, resets_at, used
  ORDER BY original DESC, ms, file, event_id) = 1)
SELECT account_id, 'quota-' || substr(sha256(substr(sha256('main'), 1, 16) || '|10080|'
         || resets_at || '|' || used), 1, 24) AS id, ms, used::DOUBLE AS used_percent, resets_at
FROM qw""")
def _(spark, d):
    return D.dedupe_quota(C.quota_records(_context(spark, d))).select(
        "account_id", "id", _ms("ts", "ms"), "used_percent", "resets_at")


_EVENTS = f"""{_LOG},
at0 AS (
  SELECT c.account_id, 'evt-' || substr(sha256(c.key), 1, 24) AS id, c.ms,
         coalesce(o.thread_id, c.thread_id) AS thread_id, coalesce(c.turn, '') AS turn_id,
         coalesce(CASE WHEN o.account_id IS NULL THEN c.model ELSE o.model END, 'unknown') AS model,
         coalesce(CASE WHEN o.account_id IS NULL THEN c.effort ELSE o.effort END, 'unknown')
           AS effort,
         CASE WHEN o.account_id IS NULL THEN c.cwd ELSE o.cwd END AS cwd,
         CASE WHEN c.original OR o.account_id IS NULL THEN c.tier ELSE o.cand_tier END
           AS service_tier,
         c.inp, least(c.inp, c.x * 17) AS cached, c.outp, c.total, c.seen_file, c.seen_ord,
         c.copies
  FROM calls c LEFT JOIN org o ON o.account_id = c.account_id AND o.cand_turn = c.turn),
rt(m, r_in, r_hit, r_out) AS (VALUES
  ('gpt-5.6-luna', 5.0::DOUBLE, 0.5::DOUBLE, 30.0::DOUBLE),
  ('gpt-5.5', 125.0::DOUBLE, 12.5::DOUBLE, 750.0::DOUBLE),
  ('gpt-5.4', 62.5::DOUBLE, 6.25::DOUBLE, 375.0::DOUBLE)),
at1 AS (
  SELECT at0.*, ((inp - cached) * r_in + cached * r_hit + outp * r_out) / 1000000.0::DOUBLE
           * CASE WHEN service_tier = 'priority' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS credits,
         coalesce(regexp_extract(cwd, '[^/]+$'), 'Unknown project') AS project
  FROM at0 LEFT JOIN rt ON rt.m = at0.model),
tc AS (SELECT *, 'tool' || (k % 4) AS name,
         CASE WHEN k % 3 = 0 THEN 'function_call' ELSE 'custom_tool_call' END AS type,
         CASE WHEN k % 3 = 0 THEN 'c' || event_id END AS stable FROM cx WHERE kind = 'call'),
nu AS (SELECT *, row_number() OVER (PARTITION BY file, turn, type, name ORDER BY event_id) AS n
       FROM tc),
ky AS (SELECT *, CASE WHEN stable IS NOT NULL THEN 'id|' || stable
         ELSE 'ordinal|' || coalesce(turn, '') || '|' || type || '|' || name || '|' || n END AS key
       FROM nu QUALIFY row_number() OVER (PARTITION BY account_id, key
                 ORDER BY original DESC, file, event_id) = 1),
kc AS (SELECT account_id, coalesce(turn, 'thread:' || thread_id) AS grp, count(*) AS n
       FROM ky GROUP BY 1, 2),
le AS (SELECT account_id, id, coalesce(nullif(turn_id, ''), 'thread:' || thread_id) AS grp FROM at1
       QUALIFY row_number() OVER (
         PARTITION BY account_id, coalesce(nullif(turn_id, ''), 'thread:' || thread_id)
         ORDER BY ms DESC, seen_file DESC, seen_ord DESC) = 1),
lev AS (SELECT at1.*, coalesce(kc.n, 0) AS tool_calls FROM at1
        LEFT JOIN le USING (account_id, id)
        LEFT JOIN kc ON kc.account_id = le.account_id AND kc.grp = le.grp)"""


@_q("resumed_context", f"""{_LOG}
SELECT account_id, file, event_id AS ord, kind, model, effort, cwd, tier AS service_tier, turn,
       original AS original_likely FROM cx""")
def _(spark, d):
    return logs.resumed_context(spark, d)


@_q("stream_equals_batch", f"""{_LOG},
ln AS (SELECT file, event_id, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no
       FROM rw)
SELECT account_id, regexp_extract(file, '[^/]+$') AS file, line_no, kind, model, effort, cwd,
       tier AS service_tier, turn, original AS original_likely
FROM cx JOIN ln USING (file, event_id)""")
def _(spark, d):
    return logs.streamed_context(spark, d)


@_q("refresh_equals_rebuild", f"""{_EVENTS}
SELECT account_id, id, ms, thread_id, project, model, effort, turn_id, service_tier, tool_calls,
       inp AS input_tokens, cached AS cached_input_tokens, outp AS output_tokens,
       total AS total_tokens, round(credits, 6) AS rate_card_credits FROM lev""")
def _(spark, d):
    led, scratch = logs.refreshed_ledger(spark, d, GENERATED)
    return scratch.release(led.events.select(
        "account_id", "id", _ms("ts", "ms"), "thread_id", "project", "model", "effort", "turn_id",
        "service_tier", "tool_calls", "input_tokens", "cached_input_tokens", "output_tokens",
        "total_tokens", *_r("rate_card_credits")))


def _ledger(spark, d):
    """The whole ledger built from the derived log."""
    lines = lines_from_table(materialize(S.log_lines(spark, d), "lines"), 2_000)
    state, edges = thread_state(spark)
    meta = ingest.Metadata(spark.createDataFrame([], TITLES_SCHEMA), state, edges)
    sources = lines.groupBy("account_id", "file").agg(
        F.sum(F.length("value") + 1).alias("size"))
    return ingest.ingest(spark, lines, sources, meta, GENERATED)


@_q("ledger_events", f"""{_EVENTS}
SELECT account_id, id, ms, thread_id, project, model, effort, turn_id, service_tier, tool_calls,
       inp AS input_tokens, cached AS cached_input_tokens, outp AS output_tokens,
       total AS total_tokens, round(credits, 6) AS rate_card_credits FROM lev""")
def _(spark, d):
    return _ledger(spark, d).events.select(
        "account_id", "id", _ms("ts", "ms"), "thread_id", "project", "model", "effort", "turn_id",
        "service_tier", "tool_calls", "input_tokens", "cached_input_tokens", "output_tokens",
        "total_tokens", *_r("rate_card_credits"))


@_q("thread_rollup", f"""{_EVENTS},
fi AS (SELECT account_id, thread_id, turn_id, model, effort FROM lev
       QUALIFY row_number() OVER (PARTITION BY account_id, thread_id
         ORDER BY ms, seen_file, seen_ord) = 1),
su AS (SELECT account_id, thread_id, CAST(sum(total) AS BIGINT) AS total_tokens,
         CAST(sum(tool_calls) AS BIGINT) AS tool_calls, count(*) AS event_count,
         CAST(sum(CASE WHEN credits IS NOT NULL THEN total ELSE 0 END) AS BIGINT) AS rated_tokens,
         sum(credits) AS c, min(ms) AS first_ms, max(ms) AS last_ms
       FROM lev GROUP BY 1, 2)
SELECT su.account_id, su.thread_id AS id,
       coalesce(CASE WHEN o.account_id IS NULL THEN fi.model ELSE o.model END, 'unknown') AS model,
       coalesce(CASE WHEN o.account_id IS NULL THEN fi.effort ELSE o.effort END, 'unknown')
         AS effort,
       coalesce(regexp_extract(o.cwd, '[^/]+$'), 'Unknown project') AS project,
       total_tokens, tool_calls, event_count, rated_tokens, first_ms, last_ms,
       round(CASE WHEN rated_tokens = total_tokens THEN c END, 6) AS rate_card_credits,
       'complete' AS coverage
FROM su JOIN fi USING (account_id, thread_id)
LEFT JOIN org o ON o.account_id = su.account_id AND o.cand_turn = nullif(fi.turn_id, '')""")
def _(spark, d):
    return _ledger(spark, d).threads.select(
        "account_id", "id", "model", "effort", "project", "total_tokens", "tool_calls",
        "event_count", "rated_tokens", _ms("first_active_at", "first_ms"),
        _ms("last_active_at", "last_ms"), *_r("rate_card_credits"), "coverage")


@_q("coverage", f"""{_EVENTS},
e AS (SELECT account_id, CAST(sum(total) AS BIGINT) AS observed_tokens,
             count(*) FILTER (turn_id = '') AS legacy_heuristic_events,
             CAST(sum(copies) - count(*) AS BIGINT) AS duplicate_events_skipped,
             min(ms) AS earliest_ms, max(ms) AS latest_ms FROM lev GROUP BY 1),
c AS (SELECT account_id, count(*) FILTER (kind = 'bad') AS parse_errors FROM cx GROUP BY 1),
k AS (SELECT account_id, count(*) FILTER (total < counter_before) AS correction_intervals
      FROM tok GROUP BY 1),
f AS (SELECT account_id, count(DISTINCT file) AS files_scanned FROM rw GROUP BY 1)
SELECT account_id, files_scanned, parse_errors, correction_intervals, duplicate_events_skipped,
       observed_tokens, legacy_heuristic_events, 100.0::DOUBLE AS detailed_percent, earliest_ms, latest_ms,
       false AS complete_since_window_start
FROM f JOIN c USING (account_id) JOIN k USING (account_id) JOIN e USING (account_id)""")
def _(spark, d):
    return _ledger(spark, d).coverage.select(
        "account_id", "files_scanned", "parse_errors", "correction_intervals",
        "duplicate_events_skipped", "observed_tokens", "legacy_heuristic_events",
        "detailed_percent", _ms("earliest_event_at", "earliest_ms"),
        _ms("latest_event_at", "latest_ms"), "complete_since_window_start")


# ---- Text -----------------------------------------------------------------------------------

_PATHED = ("text || ' see \"/Users/me/' || source || '/a b.txt\" and /tmp/' || doc_id || "
           "'/x or //srv/share/' || lang || '; url=https://example.org/a C:\\dir\\' || doc_id")


def _pathed(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat(
        "text", F.lit(' see "/Users/me/'), "source", F.lit('/a b.txt" and /tmp/'),
        F.col("doc_id").cast("string"), F.lit("/x or //srv/share/"), "lang",
        F.lit("; url=https://example.org/a C:\\dir\\"), F.col("doc_id").cast("string"),
    ).alias("text"))


@_q("redact_paths", f"""
WITH t AS (SELECT doc_id, {_PATHED} AS s FROM documents),
a AS (SELECT doc_id, regexp_replace(s,
  '''(?:/(?:[^/"''\\r\\n][^"''\\r\\n]*)?|(?://|\\\\\\\\)[^"''\\r\\n]+|[A-Za-z]:[\\\\/][^"''\\r\\n]*)''',
  '''[local path]''', 'g') AS s FROM t),
b AS (SELECT doc_id, regexp_replace(s,
  '"(?:/(?:[^/"''\\r\\n][^"''\\r\\n]*)?|(?://|\\\\\\\\)[^"''\\r\\n]+|[A-Za-z]:[\\\\/][^"''\\r\\n]*)"',
  '"[local path]"', 'g') AS s FROM a)
SELECT doc_id, regexp_replace(s,
  '(^|[\\s(\\[{{=])(?:(?://|\\\\\\\\|[A-Za-z]:[\\\\/])[^\\s"''`)\\],;}}]+|/[^/\\s"''`)\\],;}}][^\\s"''`)\\],;}}]*)',
  '\\1[local path]', 'g') AS redacted FROM b""")
def _(spark, d):
    return _pathed(spark, d).select("doc_id", L.redact_paths(F.col("text")).alias("redacted"))


# Spaces beyond ASCII, in turn by document; all of them are white space in names.
_WIDE = "\u00a0\u2003\u3000\ufeff"
_WIDE_SQL = f"substr('{_WIDE}', (doc_id % 4 + 1)::BIGINT, 1)"


@_q("wide_spaces", f"""
WITH t AS (SELECT doc_id, {_WIDE_SQL} AS sp, source FROM documents),
n AS (SELECT doc_id, sp || ' GPT-5.4' || sp || sp || 'mini_' || source AS model, 'my' || sp || 'api_' || sp || 'call-' || source AS use_type,
             '/tmp/' || source || sp || 'x' || sp || '/etc/' || source AS s FROM t)
SELECT doc_id, 'gpt-5.4-mini' AS canonical, 'My API Call ' || upper(left(regexp_extract(use_type, '[^-]+$'), 1)) || substr(regexp_extract(use_type, '[^-]+$'), 2) AS label,
       '[local path]' || {_WIDE_SQL} || 'x' || {_WIDE_SQL} || '[local path]' AS redacted,
       regexp_replace(s, '[{_WIDE}]+', ' ', 'g') AS clean
FROM n""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    sp = F.substr(F.lit(_WIDE), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("/tmp/"), "source", sp, F.lit("x"), sp, F.lit("/etc/"), "source")
    return docs.select(
        "doc_id", M.normalize_model(F.concat(sp, F.lit(" GPT-5.4"), sp, sp, F.lit("mini_"), "source")).alias("canonical"),
        L.usage_type_label(F.concat(F.lit("my"), sp, F.lit("api_"), sp, F.lit("call-"), "source")).alias("label"),
        L.redact_paths(text).alias("redacted"), L.clean_label(text, "").alias("clean"))


@_q("clean_labels", """
WITH t AS (SELECT page_id, chr(27) || '[31m' || url || chr(27) || '[0m' || chr(9) || chr(10)
             || ' page ' || page_id AS s FROM pages),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(s,
        '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\\x00-\\x1f\\x7f-\\x{9f}]+', ' ', 'g'),
        '\\s+', ' ', 'g')) AS label FROM t)
SELECT page_id, label, CASE WHEN length(label) <= 30 THEN label
         ELSE left(label, 14) || '…' || right(label, 13) END AS short_label FROM c""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    s = F.concat(F.lit("\x1b[31m"), "url", F.lit("\x1b[0m\t\n page "),
                 F.col("page_id").cast("string"))
    return pages.select("page_id", L.clean_label(s, L.UNLABELLED).alias("label"),
                        L.short_label(s).alias("short_label"))


@_q("title_redaction", """
WITH t AS (SELECT conv_id, turn, text || ' /Users/x/' || role || ' /private/tmp/y /tmp/z '
             || 'sk-abcdefghijklmnop' || conv_id || ' ghp_0123456789abcdef' || turn AS s
           FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '/Users/[^\\s"''`]+', '[local path]', 'g'),
  '/(?:private/)?tmp/[^\\s"''`]+', '[temporary path]', 'g'),
  '\\b(?:sk-[A-Za-z0-9_-]{16,}|lin_api_[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_-]{16,})\\b',
  '[redacted credential-like text]', 'g'), '\\s+', ' ', 'g') AS title FROM t""")
def _(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    s = F.concat("text", F.lit(" /Users/x/"), "role", F.lit(" /private/tmp/y /tmp/z "
                 "sk-abcdefghijklmnop"), F.col("conv_id").cast("string"),
                 F.lit(" ghp_0123456789abcdef"), F.col("turn").cast("string"))
    return conv.select("conv_id", "turn", L.redact_title(s).alias("title"))


@_q("project_labels", """
WITH t AS (SELECT page_id, url, page_id % 5 AS m,
  regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '\\.git$', '') AS path
  FROM pages),
l AS (SELECT page_id, string_split(CASE m
    WHEN 0 THEN lower(host) || '/' || path
    WHEN 1 THEN 'git.example.org/team/r' || page_id
    WHEN 4 THEN 'crew/r' || page_id
    ELSE '' END, '/') AS parts, m FROM t)
SELECT page_id, CASE WHEN m IN (0, 1, 4) THEN array_to_string(list_filter(parts, lambda p: p <> '')[-2:], '/')
  WHEN m = 2 THEN 'r' || page_id ELSE 'wt' || page_id END AS project FROM l""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    n, m = F.col("page_id").cast("string"), F.col("page_id") % 5
    remote = F.when(m == 0, F.col("url")).when(
        m == 1, F.concat(F.lit("git@git.example.org:team/r"), n, F.lit(".git"))).when(
        m == 4, F.concat(F.lit("work:crew/r"), n, F.lit(".git")))
    cwd = F.when(m == 2, F.concat(F.lit("C:\\work\\r"), n, F.lit("\\"))).otherwise(
        F.concat(F.lit("/home/u/.codex/worktrees/ab12/wt"), n))
    return pages.select("page_id", L.project_label(cwd, remote).alias("project"))


@_q("source_labels", """
WITH t AS (SELECT conv_id, turn, role, conv_id % 6 AS m FROM conversations)
SELECT conv_id, turn,
  CASE m WHEN 0 THEN 'cli' WHEN 1 THEN 'desktop' WHEN 2 THEN 'subagent' WHEN 3 THEN role
    WHEN 4 THEN 'automation' ELSE 'unknown' END AS source,
  CASE m WHEN 0 THEN 'cli' WHEN 1 THEN 'interactive' WHEN 2 THEN 'subagent'
    WHEN 3 THEN 'interactive' WHEN 4 THEN 'automation' ELSE 'unknown' END AS use_type FROM t""")
def _(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    m = F.col("conv_id") % 6
    raw = (F.when(m == 0, "exec").when(m == 1, "vscode")
           .when(m == 2, '{"subagent":{"thread_spawn":{"parent_thread_id":"p"}}}')
           .when(m == 3, F.col("role")).when(m == 5, '{"other":1}'))
    kind = F.when(m == 4, "automation")
    return conv.select("conv_id", "turn", L.source_labels(kind, raw).alias("s")).select(
        "conv_id", "turn", "s.source", "s.use_type")


@_q("usage_type_labels", """
SELECT doc_id, source || '_' || lang || '-api run' AS use_type,
  upper(source[1]) || source[2:] || ' ' || CASE WHEN lang IN ('ui') THEN upper(lang)
    ELSE upper(lang[1]) || lang[2:] END || ' API Run' AS label FROM documents""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    use = F.concat("source", F.lit("_"), "lang", F.lit("-api run"))
    return docs.select("doc_id", use.alias("use_type"), L.usage_type_label(use).alias("label"))


QUERIES.update(readers.QUERIES)
ORACLES.update(readers.ORACLES)
