"""Queries of readers, thread labels and coverage, with threads and logs of every kind."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import sample as S
from checks.logs import write_logs
from meterlake.functions import labels as L
from meterlake.operators import assemble as A
from meterlake.operators import bins as B
from meterlake.operators.dedupe import thread_parents
from meterlake.operators.windows import multi_day_window
from meterlake.sources.freshness import freshness
from meterlake.sources.metadata import thread_state, titles_from_lines
from meterlake.sources.rollouts import (
    list_sources,
    read_rollouts,
    session_roots,
    thread_id_of_file,
)
from meterlake.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOON = datetime(2024, 1, 20, 12, tzinfo=UTC)


def _q(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# Every second hundred of documents is a log with a thread's id in its name, the others are archived.
@_q("log_files", """
WITH t AS (SELECT doc_id // 100 AS f, doc_id, md5(coalesce(text, '')) || ' ' || doc_id AS value FROM documents)
SELECT CASE WHEN f % 2 = 0 THEN 'rollout-00000000-0000-4000-8000-' || lpad(f::VARCHAR, 12, '0') ELSE 'log' || f END || '.jsonl' AS file,
       CASE WHEN f % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(f::VARCHAR, 12, '0') ELSE 'file-' END AS thread_id,
       row_number() OVER (PARTITION BY f ORDER BY doc_id) AS line_no, value,
       CAST(sum(length(value) + 1) OVER (PARTITION BY f) AS BIGINT) AS bytes FROM t""")
def _(spark, d):
    scratch = Scratch(spark, "log-files")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    f = F.expr("doc_id div 100").cast("string")
    named = F.when(F.expr("doc_id div 100 % 2 = 0"), F.concat(F.lit("rollout-00000000-0000-4000-8000-"), F.lpad(f, 12, "0"))).otherwise(F.concat(F.lit("log"), f))
    lines = docs.select(F.concat(named, F.lit(".jsonl")).alias("file"), F.col("doc_id").alias("ord"),
                        F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit(" "), F.col("doc_id").cast("string")).alias("value"))
    home = scratch.path("home")
    sessions, archived = session_roots(home)
    write_logs(lines.filter("file LIKE 'rollout%'"), f"{sessions}/2024/01", 0.0, 1.0)
    write_logs(lines.filter("file LIKE 'log%'"), archived, 0.0, 1.0)
    roots = [sessions, archived, f"{home}/missing"]
    order = Window.partitionBy("file").orderBy("block", "ord")
    found = thread_id_of_file(F.col("file"))
    read = (read_rollouts(spark, roots).withColumn("line_no", F.row_number().over(order))
            .join(list_sources(spark, roots), "file"))
    return scratch.release(read.select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        F.when(found.startswith("file-"), "file-").otherwise(found).alias("thread_id"),
        F.col("line_no").cast("long").alias("line_no"), "value", F.col("size").alias("bytes")))


@_q("session_titles", """
WITH t AS (SELECT 'a' || conv_id % 3 AS account_id, 't' || conv_id AS thread_id, turn,
    CASE WHEN turn % 3 = 0 THEN 0 ELSE 1704067200 + turn * 7 % 20 END AS sec,
    CASE WHEN turn % 7 <> 0 OR conv_id % 2 = 0 THEN role || ' ' || turn || ' ' || left(md5(coalesce(text, '')), 8) ELSE '' END AS title
  FROM conversations WHERE (conv_id + turn) % 11 <> 5)
SELECT account_id, thread_id, title AS session_title FROM t WHERE title <> ''
QUALIFY row_number() OVER (PARTITION BY account_id, thread_id ORDER BY sec DESC, turn DESC) = 1""")
def _(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    turn = F.col("turn").cast("string")
    title = F.when((F.col("turn") % 7 != 0) | (F.col("conv_id") % 2 == 0), F.concat_ws(
        " ", F.concat("role", F.lit("\u00a0\u2003"), turn), F.left(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit(8)))).otherwise("")
    at = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("turn") * 7 % 20).cast("string"), 2, "0"), F.lit("Z")))
    row = F.to_json(F.struct(F.concat(F.lit("t"), F.col("conv_id")).alias("id"), title.alias("thread_name"), at.alias("updated_at")))
    return titles_from_lines(conv.select(
        F.concat(F.lit("a"), F.col("conv_id") % 3).alias("account_id"), F.expr("turn div 4").cast("long").alias("block"),
        F.col("turn").cast("long").alias("ord"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 5, F.left(row, F.lit(9))).otherwise(row).alias("value")))


# Spawn edges in the order of orders, some without a place; every fifth customer has session records as well.
@_q("thread_parents", """
WITH e AS (SELECT 't' || o_custkey AS thread_id, 'e' || o_orderkey AS parent, 0 AS rank, 0 AS file,
    CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey END AS ord FROM orders
  UNION ALL SELECT 't' || c_custkey, 'm' || f, 1, f, c_custkey FROM customer, range(2) r(f) WHERE c_custkey % 5 = 0)
SELECT thread_id, parent AS parent_thread_id FROM e
QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY rank DESC, file DESC, ord DESC, parent DESC) = 1""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    customer = spark.read.parquet(f"{d}/customer.parquet")
    edges = orders.select(
        F.concat(F.lit("e"), "o_orderkey").alias("parent_thread_id"), F.concat(F.lit("t"), "o_custkey").alias("child_thread_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("position"))
    state, edges = thread_state(spark, customer.select(F.concat(F.lit("t"), "c_custkey").alias("id")), edges)
    metas = customer.filter("c_custkey % 5 = 0").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(
        F.lit("default").alias("account_id"), F.concat(F.lit("t"), "c_custkey").alias("thread_id"),
        F.concat(F.lit("m"), "f").alias("parent_thread_id"), F.concat(F.lit("f"), "f").alias("file"),
        F.lit(0).cast("long").alias("block"), F.col("c_custkey").cast("long").alias("ord"))
    return thread_parents(edges, metas).select("thread_id", "parent_thread_id")


@_q("freshness_labels", f"""
WITH t AS (SELECT event_id, {int(NOON.timestamp() * 1000)} - epoch_ms(ts) AS age FROM events)
SELECT event_id, CASE WHEN age < 0 THEN 'unknown' WHEN age < 3600000 THEN 'fresh' ELSE 'stale' END AS status,
       CASE WHEN age < 0 THEN 'age unknown' WHEN age < 60000 THEN 'now' WHEN age < 3600000 THEN age // 60000 || 'm old'
         WHEN age < 86400000 THEN age // 3600000 || 'h old' ELSE age // 86400000 || 'd old' END AS age_label FROM t""")
def _(spark, d):
    return S.activity(spark, d).select("event_id", *freshness(F.col("ts"), NOON))


@_q("base_names", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(rtrim(url, '/'), '[^/]*$') WHEN 1 THEN 'r' || page_id ELSE 'local path' END AS name FROM pages""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    m, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = (F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("C:\\work\\r"), n, F.lit("\\\\")))
            .when(m == 2, F.lit("///")).otherwise(F.concat(F.lit("/a"), n, F.lit("/../"))))
    return pages.select("page_id", L.safe_base_name(path).alias("name"))


@_q("events_since", f"""WITH {S.SQL_EVENTS}
SELECT account_id, id FROM ev WHERE tool_calls % 2 = 0 AND ts >= TIMESTAMP '2024-01-10'""")
def _(spark, d):
    # The instant is that of the event itself or a millisecond later, and not before a date.
    start = F.greatest(F.timestamp_millis(F.unix_millis("ts") + F.col("tool_calls") % 2), F.lit(datetime(2024, 1, 10, tzinfo=UTC)))
    return A.since(S.ledger_events(spark, d), start).select("account_id", "id")


_SPANS = [(multi_day_window("2024-01-25", S.TZ, days), days, width)
          for days, width in ((14, 4), (14, 10), (14, 40), (30, 8), (30, 60), (30, 130))]


@_q("chosen_bins", f"WITH {S.SQL_EVENTS}, sz AS (SELECT *, greatest(CASE WHEN days <= 14 THEN 1 WHEN width >= 120 THEN 2 ELSE 3 END, "
    "ceil(days / width))::BIGINT AS size FROM (VALUES " + ", ".join(
        f"({days}, {width}, {b.start_ms}, {b.end_ms}, DATE '{b.first_day}')" for b, days, width in _SPANS) + """) v(days, width, lo, hi, first_day))
SELECT days, width, account_id, (day - first_day) // size AS bin, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls
FROM ev JOIN sz ON epoch_ms(ts) >= lo AND epoch_ms(ts) < hi GROUP BY ALL""")
def _(spark, d):
    events = S.ledger_events(spark, d)
    parts = [B.token_bins(events, b, B.choose_bin_size(days, width)).groupBy("account_id", "bin").agg(
        F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")).select(F.lit(days).alias("days"), F.lit(width).alias("width"), "*")
        for b, days, width in _SPANS]
    return reduce(DataFrame.unionByName, parts)


def _number(c: str):
    return F.substr(F.col(c), F.lit(2)).cast("long")


def _events(spark, d) -> DataFrame:
    """Ledger events with whole, partial and missing breakdowns, by thread."""
    n, event = _number("thread_id"), _number("id")
    whole = (n % 4).isin(0, 3) | ((n % 4 == 1) & (event % 2 == 0))
    return S.ledger_events(spark, d).withColumn("breakdown_available", whole).withColumn("turn_id", F.lit(None).cast("string")).withColumn(
        "dedupe_quality", F.when(F.col("tool_calls") == 3, "legacy-heuristic").otherwise("turn-id"))


def _threads(spark, d) -> DataFrame:
    """Threads of the log, of the state table, or of both, with titles of every kind."""
    n = F.col("n")
    known = S.ledger_threads(spark, d).withColumn("n", _number("id"))
    own = F.col("id").startswith("t")
    state = known.filter(~own | (n % 4 != 3)).select(
        "account_id", "id", (n + 1_704_067_200).cast("double").alias("created_at"), (n + 1_704_068_200).cast("double").alias("updated_at"),
        F.when(n % 3 == 0, '{"subagent":{"x":1}}').when(n % 3 == 1, "exec").alias("source"), F.concat(F.lit("/w/"), "project").alias("cwd"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, F.repeat(F.lit("long "), 30))
        .when(n % 5 == 2, "See /Users/me/x, sk-abcdefghijklmnop0").otherwise(F.concat(F.lit("Task "), n)).alias("title"),
        F.when(n % 2 == 0, F.concat(F.lit("Name "), n)).alias("name"),
        F.when(own, n * 10).when(n % 2 == 0, n * 100).otherwise(0).cast("double").alias("tokens_used"),
        F.when(n % 7 == 0, "Nick").alias("agent_nickname"), F.lit("gpt-5.5").alias("model"), F.lit("low").alias("reasoning_effort"),
        F.when(n % 6 == 2, "automation").alias("thread_source"))
    edges = known.filter("n % 8 = 0").select("account_id", F.concat(F.lit("p"), n).alias("parent_thread_id"), F.col("id").alias("child_thread_id"))
    state, edges = thread_state(spark, state, edges)
    titles = known.filter("n % 6 = 0").select("account_id", F.col("id").alias("thread_id"), F.concat(F.lit("Session "), n).alias("session_title"))
    metas = spark.createDataFrame([], "account_id string, thread_id string, parent_thread_id string, file string, block long, ord long")
    origins = spark.createDataFrame([], "account_id string, turn string, origin struct<model string, effort string, cwd string, git string, raw_source string>")
    return A.rollup_threads(_events(spark, d), A.thread_facts(state, titles, thread_parents(edges, metas)), origins)


_THREADS = f"""WITH {S.SQL_EVENTS}, {S.SQL_THREADS},
st AS (SELECT account_id, id, project, CAST(substr(id, 2) AS BIGINT) AS n, id[1] = 't' AS own FROM thr),
su AS (SELECT account_id, thread_id AS id, count(*) AS event_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(CASE WHEN u % 4 IN (0, 3) OR (u % 4 = 1 AND event_id % 2 = 0) THEN total_tokens ELSE 0 END) AS BIGINT) AS detailed_tokens,
    min(epoch_ms(ts)) AS first_ms, max(epoch_ms(ts)) AS last_ms, arg_min(effort, (epoch_ms(ts), event_id)) AS effort
  FROM (SELECT *, CAST(substr(thread_id, 2) AS BIGINT) AS u FROM ev) GROUP BY 1, 2),
fc AS (SELECT *, NOT own OR n % 4 <> 3 AS in_state FROM st),
fd AS (SELECT account_id, id, n, project, in_state,
    CASE WHEN in_state THEN CASE WHEN own THEN n * 10 WHEN n % 2 = 0 THEN n * 100 ELSE 0 END END AS reported,
    in_state AND n % 3 = 0 AS sub, in_state AND n % 6 = 2 AS auto,
    CASE WHEN n % 6 = 0 THEN 'Session ' || n WHEN NOT in_state THEN '' WHEN n % 5 = 0 THEN CASE WHEN n % 2 = 0 THEN 'Name ' || n ELSE '' END
      WHEN n % 5 = 1 THEN trim(repeat('long ', 30))
      WHEN n % 5 = 2 THEN 'See /Users/me/x, sk-abcdefghijklmnop0' ELSE 'Task ' || n END AS t FROM fc),
th AS (SELECT account_id, id, coalesce(event_count, 0) AS event_count, coalesce(total_tokens, 0) AS total_tokens,
    coalesce(detailed_tokens, 0) AS detailed_tokens, reported AS reported_cumulative_tokens,
    CASE WHEN t = '' OR (sub AND length(t) > 120) THEN CASE WHEN in_state AND n % 7 = 0 THEN 'Subagent · Nick' WHEN sub THEN 'Subagent · ' || left(id, 8) ELSE 'Untitled task' END
      WHEN t LIKE 'See %' THEN 'See [local path] [redacted credential-like text]' ELSE t END AS title,
    CASE WHEN in_state THEN project ELSE 'Unknown project' END AS project, coalesce(effort, 'low') AS effort,
    CASE WHEN sub THEN 'subagent' WHEN auto THEN 'automation' WHEN in_state AND n % 3 = 1 THEN 'cli' ELSE 'unknown' END AS source,
    CASE WHEN sub THEN 'subagent' WHEN auto THEN 'automation' WHEN in_state AND n % 3 = 1 THEN 'cli' ELSE 'unknown' END AS use_type,
    CASE WHEN n % 8 = 0 THEN 'p' || n END AS parent_thread_id,
    coalesce(first_ms, (1704067200 + n) * 1000) AS first_ms, coalesce(last_ms, (1704068200 + n) * 1000) AS last_ms,
    CASE WHEN event_count IS NULL THEN 'unresolved' WHEN detailed_tokens = total_tokens THEN 'complete'
      WHEN detailed_tokens > 0 THEN 'partial' ELSE 'total-only' END AS coverage
  FROM fd LEFT JOIN su USING (account_id, id) WHERE event_count > 0 OR reported > 0)"""


@_q("thread_states", f"{_THREADS} SELECT * FROM th")
def _(spark, d):
    return _threads(spark, d).select(
        "account_id", "id", "event_count", "total_tokens", "detailed_tokens", "reported_cumulative_tokens", "title", "project", "effort",
        "source", "use_type", "parent_thread_id", F.unix_millis("first_active_at").alias("first_ms"),
        F.unix_millis("last_active_at").alias("last_ms"), "coverage")


# One account's log begins late, one has lines that do not parse, one is whole; a fourth has files only.
@_q("coverage_of_parts", f"""{_THREADS}, {S.SQL_QUOTA},
e AS (SELECT account_id, CAST(sum(total_tokens) AS BIGINT) AS observed_tokens,
    CAST(sum(CASE WHEN u % 4 IN (0, 3) OR (u % 4 = 1 AND event_id % 2 = 0) THEN total_tokens ELSE 0 END) AS BIGINT) AS detailed_tokens,
    count(*) FILTER (tool_calls = 3) AS legacy_heuristic_events, CAST(sum(tool_calls % 2) AS BIGINT) AS duplicate_events_skipped, min(epoch_ms(ts)) AS earliest_ms
  FROM (SELECT *, CAST(substr(thread_id, 2) AS BIGINT) AS u FROM ev) WHERE account_id <> 'a0' OR ts >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1),
p AS (SELECT account_id, count(*) FILTER (account_id = 'a1' AND event_id % 97 = 0) AS parse_errors FROM ev GROUP BY 1),
w AS (SELECT account_id, resets_at * 1000 - 604800000 AS start_ms FROM ob
      QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY pool, ms DESC, event_id) = 1),
u AS (SELECT account_id, CAST(sum(coalesce(reported_cumulative_tokens, 0)) AS BIGINT) AS state_counter_sum_non_additive,
        count(*) FILTER (coverage = 'unresolved') AS unresolved_thread_counters FROM th GROUP BY 1),
f AS (SELECT CASE WHEN g = 1 THEN 'a9' ELSE account_id END AS account_id, user_id, event_id FROM (SELECT *, unnest(CASE WHEN user_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS g
        FROM (SELECT 'a' || (user_id % 3) AS account_id, user_id, event_id FROM raw))),
s AS (SELECT account_id, count(DISTINCT user_id) AS files_scanned, count(*) * 10 AS bytes_scanned FROM f GROUP BY 1)
SELECT account_id, files_scanned, bytes_scanned, coalesce(parse_errors, 0) AS parse_errors, coalesce(observed_tokens, 0) AS observed_tokens,
       coalesce(observed_tokens - detailed_tokens, 0) AS unknown_breakdown_tokens,
       CASE WHEN observed_tokens > 0 THEN round(100.0::DOUBLE * detailed_tokens / observed_tokens, 6) ELSE 100.0::DOUBLE END AS detailed_percent,
       coalesce(legacy_heuristic_events, 0) AS legacy_heuristic_events, coalesce(duplicate_events_skipped, 0) AS duplicate_events_skipped,
       coalesce(state_counter_sum_non_additive, 0) AS state_counter_sum_non_additive, coalesce(unresolved_thread_counters, 0) AS unresolved_thread_counters,
       coalesce(earliest_ms <= start_ms AND parse_errors = 0, false) AS complete_since_window_start
FROM s LEFT JOIN e USING (account_id) LEFT JOIN p USING (account_id) LEFT JOIN w USING (account_id) LEFT JOIN u USING (account_id)""")
def _(spark, d):
    whole = _events(spark, d)
    events = whole.filter((F.col("account_id") != "a0") | (F.col("ts") >= F.lit(datetime(2024, 1, 30, 12, tzinfo=UTC))))
    counters = whole.select("account_id", F.when((F.col("account_id") == "a1") & (_number("id") % 97 == 0), 1).otherwise(0).alias("parse_errors"),
                            F.lit(0).alias("correction_intervals"))
    files = whole.groupBy("account_id", F.col("thread_id").alias("file")).agg((F.count("*") * 10).alias("size"))
    files = files.unionByName(files.filter(_number("file") % 50 == 0).withColumn("account_id", F.lit("a9")))
    calls = events.select("account_id", (1 + F.col("tool_calls") % 2).alias("copies"))
    return A.coverage(files, counters, calls, events, _threads(spark, d), S.quota_observations(spark, d)).select(
        "account_id", "files_scanned", "bytes_scanned", "parse_errors", "observed_tokens", "unknown_breakdown_tokens",
        F.round("detailed_percent", 6).alias("detailed_percent"), "legacy_heuristic_events", "duplicate_events_skipped",
        "state_counter_sum_non_additive", "unresolved_thread_counters", "complete_since_window_start")
