"""A usage ledger and usage logs derived from the given `events` table.

Every activity row becomes one model call, and every `view` row a reading of the weekly meter. For
the log queries the same rows become log lines. Token counts are multiples of 16, so that credit
sums are whole millionths and do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.windows import multi_day_window, week_window

TZ = "Pacific/Honolulu"
WEEK = week_window("2024-01-20", TZ)
TREND = multi_day_window("2024-01-25", TZ, 14)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        "event_id", "user_id", "event_type",
        F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"),
        F.floor(F.col("value") * 10).cast("long").alias("x"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _account():
    return F.concat(F.lit("a"), F.col("user_id") % 3).alias("account_id")


def _seen():
    return F.struct(
        F.lit("").alias("file"), F.lit(0).cast("long").alias("block"),
        F.col("event_id").alias("ord"), F.lit(0).alias("part")).alias("seen")


def _project():
    j = F.expr("user_id div 3")
    return F.when(j % 7 == 0, F.concat(F.lit("solo"), "user_id")).otherwise(
        F.concat(F.lit("p"), j % 12))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x, kind = F.col("k"), F.col("x"), F.col("event_type")
    model = (
        F.when(kind == "click", "gpt-5.6-luna").when(kind == "view", "gpt-5.6-sol")
        .when(kind == "purchase", "GPT-5.4 mini").when(kind == "signup", "gpt-5.5")
        .otherwise("lab_model"))
    inp, out = x * 16, (k * 112).cast("long")
    return activity(spark, sf_dir).select(
        _account(), F.concat(F.lit("e"), "event_id").alias("id"), "ts",
        F.concat(F.lit("t"), "user_id").alias("thread_id"), _project().alias("project"),
        model.alias("model"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("effort"),
        F.concat_ws("_", kind, (k % 3).cast("string")).alias("use_type"),
        (k % 4).cast("long").alias("tool_calls"),
        F.when(k % 5 == 0, "priority").alias("service_tier"),
        inp.alias("input_tokens"), (F.expr("x * (k % 80) div 100") * 16)
        .alias("cached_input_tokens"),
        out.alias("output_tokens"), F.expr("(k * 112) div 4").cast("long")
        .alias("reasoning_tokens"),
        (inp + out + F.when(k % 10 == 0, 1).otherwise(0)).alias("total_tokens"),
        F.when(k % 7 != 0, k / 4.0).alias("rate_card_credits"), _seen())


def ledger_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the users, and for some a second thread that only the state table knows."""
    users = activity(spark, sf_dir).select("user_id").distinct()
    own = users.select(_account(), F.concat(F.lit("t"), "user_id").alias("id"),
                       _project().alias("project"))
    more = users.filter("(user_id div 3) % 14 = 0").select(
        _account(), F.concat(F.lit("x"), "user_id").alias("id"), _project().alias("project"))
    return own.unionByName(more)


def quota_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = 604_800
    a = activity(spark, sf_dir).filter("event_type = 'view'")
    s = F.unix_seconds("ts") - F.lit(1_704_067_200)
    a = a.withColumn("w", F.floor(s / week).cast("long")).withColumn(
        "into", (s - F.col("w") * week).cast("long"))
    restarted = (F.col("w") == 2) & (F.col("into") >= 3 * 86_400)
    stale = (F.col("event_id") % 50 == 0) & (F.col("into") < 86_400) & (F.col("w") > 0)
    lone = F.col("event_id") % 4_999 == 1
    resets = (
        F.lit(1_704_067_200) + (F.col("w") + 1) * week + (F.col("event_id") % 3) * 60
        + F.when(restarted, 3 * 86_400).otherwise(0) - F.when(stale, week).otherwise(0)
        + F.when(lone, 2 * 86_400).otherwise(0))
    ran = F.when(restarted, F.col("into") - 3 * 86_400).otherwise(F.col("into"))
    used = F.floor(ran * 100 / week) - F.col("k") % 4
    pool = F.col("event_id") % 11 == 0
    return a.select(
        _account(), "ts", used.cast("double").alias("used_percent"),
        F.lit(10_080).alias("window_minutes"), resets.cast("long").alias("resets_at"),
        F.when(pool, "pool").otherwise("main").alias("limit_key"),
        F.when(pool, "Pool").alias("limit_name"),
        F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast("timestamp").alias("event_cutoff_at"), _seen())


def drifting_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose reset times drift and jitter, so that those of an account hang together."""
    a = activity(spark, sf_dir).filter("event_type = 'view'")
    hours = F.expr("(unix_seconds(ts) - 1704067200) div 3600")
    resets = F.lit(1_705_000_000) + hours * 20 + (F.col("event_id") * 7919) % 1_301
    return a.select(
        _account(), "ts", (F.col("k") % 100).cast("double").alias("used_percent"),
        F.lit(10_080).alias("window_minutes"), resets.cast("long").alias("resets_at"),
        F.lit("main").alias("limit_key"), F.lit(None).cast("string").alias("limit_name"),
        F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast("timestamp").alias("event_cutoff_at"), _seen())


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file per user, and for each tenth user a fork holding half of its lines an hour on.

    Every 97th line is cut short.
    """
    a = activity(spark, sf_dir)
    copies = F.when(F.col("user_id") % 10 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    rows = a.withColumn("copy", F.explode(copies)).filter("copy = 0 or event_id % 2 = 0")
    k, kind = F.col("k"), F.col("event_type")
    at = F.timestamp_millis(F.unix_millis("ts") + F.col("copy") * 3_600_000)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    total = F.col("x") * 16 + k * 112

    def usage(inp, cached, out, reasoning, tot):
        return F.struct(
            inp.alias("input_tokens"), cached.alias("cached_input_tokens"),
            out.alias("output_tokens"), reasoning.alias("reasoning_output_tokens"),
            tot.alias("total_tokens"))

    def record(typ: str, payload):
        return F.to_json(F.struct(
            stamp.alias("timestamp"), F.lit(typ).alias("type"), payload.alias("payload")))

    start = record("event_msg", F.struct(
        F.lit("task_started").alias("type"),
        F.when(k % 11 != 0, F.concat(F.lit("turn-"), "event_id")).alias("turn_id"),
        F.when(k % 9 != 0, F.unix_seconds("ts")).alias("started_at")))
    turn = record("turn_context", F.struct(
        F.when(k % 13 == 0, F.concat(F.lit("ctx-"), "event_id")).alias("turn_id"),
        F.when(k % 4 != 1, F.concat(F.lit("gpt-5."), F.lit(4) + k % 3)).alias("model"),
        F.when(k % 3 != 1, F.when(k % 3 == 0, "low").otherwise("high")).alias("effort"),
        F.when(k % 4 != 0, F.concat(F.lit("/work/p"), k % 6)).alias("cwd")))
    settings = record("event_msg", F.struct(
        F.lit("thread_settings_applied").alias("type"),
        F.struct(
            F.when(k % 2 == 0, "gpt-5.6-luna").alias("model"),
            F.when(k % 3 == 0, "priority").when(k % 3 == 1, "").alias("service_tier"),
        ).alias("thread_settings")))
    last = F.when(k % 17 == 0, F.lit(0).cast("long")).otherwise(total)
    tokens = record("event_msg", F.struct(
        F.lit("token_count").alias("type"),
        F.struct(
            usage(F.col("x") * 16, F.col("x"), k * 112, k, total).alias("total_token_usage"),
            usage(F.col("x") * 16, F.col("x") * 17, k * 112, k, last).alias("last_token_usage"),
            F.lit(200_000).alias("model_context_window")).alias("info"),
        F.when(k % 2 == 0, F.struct(
            F.lit("main").alias("limit_id"),
            F.struct(F.lit(10_080).alias("window_minutes"), (k % 50).alias("used_percent"),
                     (F.lit(1_704_067_200) + (F.col("event_id") % 4) * 604_800).alias("resets_at"))
            .alias("primary"))).alias("rate_limits")))
    call = record("response_item", F.struct(
        F.when(k % 3 == 0, "function_call").when(k % 3 == 1, "custom_tool_call")
        .otherwise("message").alias("type"),
        F.concat(F.lit("tool"), k % 4).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), "event_id")).alias("call_id")))
    value = (
        F.when(kind == "signup", start).when(kind == "click", turn)
        .when(kind == "purchase", settings).when(kind == "view", tokens).otherwise(call))
    broken = F.col("event_id") % 97 == 0
    name = F.concat(
        F.when(F.col("copy") == 0, "/logs/sessions/rollout-00000000")
        .otherwise("/logs/sessions/fork-0000000f"),
        F.lit("-0000-4000-8000-"), F.lpad(F.col("user_id").cast("string"), 12, "0"),
        F.lit(".jsonl"))
    return rows.select(
        _account(), name.alias("file"), F.col("event_id").alias("ord"),
        F.when(broken, F.substring(value, F.lit(1), F.length(value) - 5)).otherwise(value)
        .alias("value"))


# The same derivations in SQL.
SQL_EVENTS = """
raw AS (
  SELECT event_id, user_id, event_type, date_trunc('milliseconds', ts) AS ts,
         CAST(floor(value * 10) AS BIGINT) AS x,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
ev0 AS (
  SELECT 'a' || (user_id % 3) AS account_id, event_id, 'e' || event_id AS id, ts, k,
         't' || user_id AS thread_id,
         CASE WHEN (user_id // 3) % 7 = 0 THEN 'solo' || user_id
              ELSE 'p' || ((user_id // 3) % 12) END AS project,
         CASE event_type WHEN 'click' THEN 'gpt-5.6-luna' WHEN 'view' THEN 'gpt-5.6-sol'
              WHEN 'purchase' THEN 'GPT-5.4 mini' WHEN 'signup' THEN 'gpt-5.5'
              ELSE 'lab_model' END AS model,
         CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS effort,
         event_type || '_' || (k % 3) AS use_type, k % 4 AS tool_calls,
         CASE WHEN k % 5 = 0 THEN 'priority' END AS service_tier,
         x * 16 AS input_tokens, (x * (k % 80) // 100) * 16 AS cached_input_tokens,
         k * 112 AS output_tokens, (k * 112) // 4 AS reasoning_tokens,
         x * 16 + k * 112 + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS total_tokens,
         CASE WHEN k % 7 <> 0 THEN k / 4.0::DOUBLE END AS stored,
         CASE event_type WHEN 'click' THEN 5.0::DOUBLE WHEN 'view' THEN 125.0::DOUBLE
              WHEN 'purchase' THEN 18.75::DOUBLE WHEN 'signup' THEN 125.0::DOUBLE END AS r_in,
         CASE event_type WHEN 'click' THEN 0.5::DOUBLE WHEN 'view' THEN 12.5::DOUBLE
              WHEN 'purchase' THEN 1.875::DOUBLE WHEN 'signup' THEN 12.5::DOUBLE END AS r_hit,
         CASE event_type WHEN 'click' THEN 30.0::DOUBLE WHEN 'view' THEN 750.0::DOUBLE
              WHEN 'purchase' THEN 113.0::DOUBLE WHEN 'signup' THEN 750.0::DOUBLE END AS r_out,
         CASE event_type WHEN 'click' THEN 'Luna' WHEN 'view' THEN 'Sol'
              WHEN 'signup' THEN 'GPT-5.5' ELSE 'Other' END AS family,
         CAST(ts - INTERVAL 10 HOUR AS DATE) AS day
  FROM raw),
ev1 AS (
  SELECT *, CASE WHEN total_tokens = 0 OR input_tokens + output_tokens = total_tokens
    THEN ((input_tokens - cached_input_tokens) * r_in + cached_input_tokens * r_hit
          + output_tokens * r_out) / 1000000.0::DOUBLE END AS base
  FROM ev0),
ev AS (
  SELECT *, coalesce(CASE WHEN service_tier = 'priority' THEN base * 1.5::DOUBLE ELSE base END,
                     stored) AS credits
  FROM ev1)"""

SQL_THREADS = """
usr AS (SELECT DISTINCT account_id, thread_id, project,
               CAST(substr(thread_id, 2) AS BIGINT) AS user_id FROM ev),
thr AS (
  SELECT account_id, thread_id AS id, project FROM usr
  UNION ALL
  SELECT account_id, 'x' || user_id, project FROM usr WHERE (user_id // 3) % 14 = 0)"""

SQL_QUOTA = """
vw AS (
  SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s FROM raw WHERE event_type = 'view'),
vw1 AS (SELECT *, s // 604800 AS w, s % 604800 AS into_w FROM vw),
vw2 AS (SELECT *, w = 2 AND into_w >= 259200 AS restarted,
               event_id % 50 = 0 AND into_w < 86400 AND w > 0 AS stale,
               event_id % 4999 = 1 AS lone FROM vw1),
ob AS (
  SELECT 'a' || (user_id % 3) AS account_id, event_id, epoch_ms(ts) AS ms,
         greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST(floor(
           (into_w - CASE WHEN restarted THEN 259200 ELSE 0 END) * 100 / 604800.0::DOUBLE)
           AS DOUBLE) - k % 4)) AS used,
         1704067200 + (w + 1) * 604800 + (event_id % 3) * 60
           + CASE WHEN restarted THEN 259200 ELSE 0 END
           - CASE WHEN stale THEN 604800 ELSE 0 END
           + CASE WHEN lone THEN 172800 ELSE 0 END AS resets_at,
         event_id % 11 = 0 AS pool
  FROM vw2)"""

# The meter's timeline; every window of the sample is at most five minutes wide.
SQL_TIMELINE = """
ma AS (SELECT * FROM ob WHERE NOT pool),
gp AS (
  SELECT account_id, resets_at,
         CASE WHEN resets_at - lag(resets_at) OVER (PARTITION BY account_id ORDER BY resets_at)
                   <= 300 THEN 0 ELSE 1 END AS opens
  FROM (SELECT DISTINCT account_id, resets_at FROM ma)),
cl AS (
  SELECT account_id, resets_at,
         sum(opens) OVER (PARTITION BY account_id ORDER BY resets_at) AS epoch FROM gp),
pl AS (SELECT ma.*, cl.epoch FROM ma JOIN cl USING (account_id, resets_at)),
ep AS (
  SELECT account_id, epoch, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms,
         max(resets_at) AS top FROM pl GROUP BY ALL),
kp AS (
  SELECT * FROM ep e WHERE n > 2 OR NOT EXISTS (
    SELECT 1 FROM ep o WHERE o.account_id = e.account_id AND o.n > e.n
      AND o.first_ms < e.first_ms AND o.last_ms > e.last_ms)),
cy AS (
  SELECT *, row_number() OVER w - 1 AS cycle, lead(first_ms) OVER w AS next_ms
  FROM kp WINDOW w AS (PARTITION BY account_id ORDER BY first_ms, top)),
ce AS (
  SELECT *, lag(top) OVER (PARTITION BY account_id ORDER BY cycle) AS prev_top
  FROM cy WHERE next_ms IS NULL OR first_ms < next_ms),
tl0 AS (
  SELECT pl.account_id, pl.event_id, ms, pl.resets_at, used, ce.cycle, ce.prev_top, ce.first_ms,
         (ce.top - 604800) * 1000 AS cycle_ms,
         CASE WHEN prev_top IS NULL THEN 'start'
              WHEN prev_top * 1000 <= ce.first_ms + 300000 THEN 'weekly-expiry'
              ELSE 'restart' END AS kind
  FROM pl JOIN ce USING (account_id, epoch) WHERE next_ms IS NULL OR ms < next_ms),
tl AS (
  SELECT *, max(used) OVER w AS norm,
         max(used) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         prev_top IS NOT NULL AND row_number() OVER w = 1 AS reset
  FROM tl0 WINDOW w AS (PARTITION BY account_id, cycle ORDER BY ms, resets_at, event_id))"""


def sql_burn(end_ms: int) -> str:
    """Spans and their attribution, up to the end of a window."""
    return f"""
st AS (SELECT *, greatest(0, norm - coalesce(before, 0)) AS points FROM tl WHERE ms < {end_ms}),
oc AS (
  SELECT account_id, cycle, min(ms) AS first_ms, max(ms) AS last_ms, min(cycle_ms) AS cycle_ms
  FROM st GROUP BY ALL),
op AS (
  SELECT account_id, cycle, least(first_ms, greatest(cycle_ms, coalesce(
           lag(last_ms) OVER (PARTITION BY account_id ORDER BY cycle), cycle_ms))) AS opened
  FROM oc),
sp AS (
  SELECT account_id, cycle, norm, points, ms AS end_ms,
         coalesce(lag(ms) OVER (PARTITION BY account_id, cycle ORDER BY ms, resets_at, event_id),
                  opened) AS start_ms
  FROM st JOIN op USING (account_id, cycle) WHERE points > 0),
pe AS (
  SELECT sp.*, e.family, e.day, e.total_tokens AS tokens,
         CASE WHEN e.credits > 0 THEN e.credits END AS rated
  FROM sp LEFT JOIN ev e ON e.account_id = sp.account_id AND epoch_ms(e.ts) > sp.start_ms
    AND epoch_ms(e.ts) <= sp.end_ms),
un AS (
  SELECT account_id, cycle, norm, coalesce(sum(rated) / sum(CASE WHEN rated IS NOT NULL
           THEN tokens END), 1) AS unit,
         coalesce(sum(rated), 0) AS rc,
         coalesce(sum(CASE WHEN rated IS NULL THEN tokens END), 0) AS ut
  FROM pe GROUP BY ALL),
we AS (
  SELECT pe.*, un.rc, un.ut, coalesce(rated, tokens * unit) AS weight
  FROM pe JOIN un USING (account_id, cycle, norm)),
wt AS (
  SELECT *, sum(weight) OVER (PARTITION BY account_id, cycle, norm) AS total FROM we),
co AS (
  SELECT account_id, cycle, norm, start_ms, end_ms, points, family AS model,
         points * sum(weight) / any_value(total) AS model_points,
         CAST(sum(tokens) AS BIGINT) AS model_tokens,
         CASE WHEN any_value(rc) > 0 AND any_value(ut) > 0 THEN 'mixed'
              WHEN any_value(rc) > 0 THEN 'rate-card' ELSE 'tokens' END AS method
  FROM wt WHERE total > 0 AND weight > 0
  GROUP BY account_id, cycle, norm, start_ms, end_ms, points, family
  UNION ALL
  SELECT DISTINCT account_id, cycle, norm, start_ms, end_ms, points, 'Unattributed', points, 0,
         'unattributed'
  FROM wt WHERE total IS NULL OR total = 0),
ds AS (
  SELECT account_id, cycle, norm, start_ms, end_ms, day, sum(weight) / any_value(total) AS share
  FROM wt WHERE total > 0 AND weight > 0
  GROUP BY account_id, cycle, norm, start_ms, end_ms, day
  UNION ALL
  SELECT account_id, cycle, norm, start_ms, end_ms, day, share FROM (
    SELECT DISTINCT account_id, cycle, norm, start_ms, end_ms,
           CAST(d AS DATE) AS day,
           CASE WHEN end_ms = start_ms THEN 1.0 ELSE
             (least(end_ms, epoch_ms(CAST(d AS TIMESTAMP) + INTERVAL 34 HOUR))
              - greatest(start_ms, epoch_ms(CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR)))
             / (end_ms - start_ms)::DOUBLE END AS share
    FROM (SELECT * FROM wt WHERE total IS NULL OR total = 0),
         unnest(generate_series(date_trunc('day', epoch_ms(start_ms) - INTERVAL 10 HOUR),
                                date_trunc('day', epoch_ms(end_ms) - INTERVAL 10 HOUR),
                                INTERVAL 1 DAY)) AS g(d))
  WHERE share > 0)"""


SQL_LOG = """
raw AS (
  SELECT event_id, user_id, event_type, date_trunc('milliseconds', ts) AS ts,
         CAST(floor(value * 10) AS BIGINT) AS x,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
rw AS (
  SELECT r.*, c.copy, 'a' || (user_id % 3) AS account_id,
         CASE WHEN c.copy = 0 THEN '/logs/sessions/rollout-00000000'
              ELSE '/logs/sessions/fork-0000000f' END
           || '-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') || '.jsonl' AS file,
         CASE WHEN c.copy = 0 THEN '00000000' ELSE '0000000f' END
           || '-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS thread_id,
         epoch_ms(ts) + c.copy * 3600000 AS ms, event_id % 97 = 0 AS bad,
         CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_type = 'signup' THEN 'start'
              WHEN event_type = 'click' THEN 'turn' WHEN event_type = 'purchase' THEN 'settings'
              WHEN event_type = 'view' THEN 'tokens'
              WHEN k % 3 < 2 THEN 'call' END AS kind
  FROM raw r JOIN (VALUES (0), (1)) c(copy)
    ON c.copy = 0 OR (user_id % 10 = 0 AND event_id % 2 = 0)),
cx0 AS (
  SELECT *,
    CASE kind WHEN 'start' THEN CASE WHEN k % 11 <> 0 THEN 'turn-' || event_id END
              WHEN 'turn' THEN CASE WHEN k % 13 = 0 THEN 'ctx-' || event_id END END AS turn_id,
    CASE kind WHEN 'turn' THEN CASE WHEN k % 4 <> 1 THEN 'gpt-5.' || (4 + k % 3) END
              WHEN 'settings' THEN CASE WHEN k % 2 = 0 THEN 'gpt-5.6-luna' END END AS set_model,
    CASE WHEN kind = 'turn' AND k % 3 <> 1
         THEN CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END END AS set_effort,
    CASE WHEN kind = 'turn' AND k % 4 <> 0 THEN '/work/p' || (k % 6) END AS set_cwd,
    CASE WHEN kind = 'settings' THEN CASE WHEN k % 3 = 0 THEN 'priority' ELSE '' END END AS set_tier,
    CASE WHEN kind = 'start' THEN event_id END AS start_at,
    CASE WHEN kind = 'start' THEN CASE WHEN k % 9 <> 0
      THEN ms - CAST(floor(epoch(ts)) AS BIGINT) * 1000 ELSE ms END END AS delta_ms
  FROM rw WHERE kind IS NOT NULL),
cx1 AS (
  SELECT *,
    last_value(set_model IGNORE NULLS) OVER w AS model,
    last_value(set_effort IGNORE NULLS) OVER w AS effort,
    last_value(set_cwd IGNORE NULLS) OVER w AS cwd,
    nullif(last_value(set_tier IGNORE NULLS) OVER w, '') AS tier,
    last_value(turn_id IGNORE NULLS) OVER w AS turn,
    last_value(start_at IGNORE NULLS) OVER w AS start_ord,
    last_value(delta_ms IGNORE NULLS) OVER w AS delta,
    last_value(CASE WHEN kind = 'start' THEN coalesce(turn_id, '') END IGNORE NULLS) OVER w
      AS start_turn,
    min(CASE WHEN turn_id IS NOT NULL THEN event_id END) OVER w AS first_turn
  FROM cx0 WINDOW w AS (PARTITION BY file ORDER BY event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cx AS (
  SELECT *, coalesce(start_ord >= first_turn, false) AS usable,
         coalesce(start_ord >= first_turn AND delta <= 2000, false) AS original
  FROM cx1),
cd0 AS (
  SELECT *, row_number() OVER (PARTITION BY file, start_ord ORDER BY event_id DESC) AS back,
         first_value(turn) OVER v AS cand_turn, first_value(tier) OVER v AS cand_tier
  FROM cx WHERE usable AND (kind = 'start' OR (kind = 'turn' AND turn = start_turn))
  WINDOW v AS (PARTITION BY file, start_ord ORDER BY event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand AS (SELECT * FROM cd0 WHERE back = 1),
org AS (
  SELECT * FROM cand QUALIFY row_number() OVER (
    PARTITION BY account_id, cand_turn ORDER BY delta, file, start_ord) = 1),
tok AS (
  SELECT *, x * 16 AS inp, k * 112 AS outp, x * 16 + k * 112 AS total,
         lag(x * 16 + k * 112) OVER (PARTITION BY file ORDER BY event_id) AS counter_before
  FROM cx WHERE kind = 'tokens' AND k % 17 <> 0 AND x * 16 + k * 112 > 0),
win AS (
  SELECT *, row_number() OVER (w ORDER BY original DESC, file, event_id) AS pick,
         count(*) OVER w AS copies,
         first_value(file) OVER (w ORDER BY file, event_id) AS seen_file,
         first_value(event_id) OVER (w ORDER BY file, event_id) AS seen_ord
  FROM tok WINDOW w AS (PARTITION BY account_id, turn, x, k)),
calls AS (
  SELECT *, '[\\"' || coalesce(turn, 'legacy') || '\\",[' || inp || ',' || x || ',0,' || outp || ','
    || k || ',' || total || '],[' || inp || ',' || x * 17 || ',0,' || outp || ',' || k || ','
    || total || '],200000]' AS key
  FROM win WHERE pick = 1)""".replace('\\"', '"')
