"""Session logs: listing, ordered lines and tolerant parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.numbers import finite_number, hash_id, token_count
from meterlake.keys import ACCOUNT

LINES_SCHEMA = (
    f"{ACCOUNT} string, file string, block long, ord long, split boolean, value string"
)

# The ending of a log's file name, and the payload types that are tool calls.
THREAD_ID_AT_END = (
    r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"
)
CALL_TYPES = [
    "function_call", "custom_tool_call", "tool_search_call",
    "web_search_call", "image_generation_call",
]


def _account(account: str | Column) -> Column:
    return F.lit(account) if isinstance(account, str) else account


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def plain_path(uri: Column) -> Column:
    """A file's path without the local scheme and without percent escapes."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(
        F.regexp_replace(uri, "^file:/+", "/"), r"\+", "%2B")), uri)


def session_roots(home: str, include_archived: bool = True) -> list[str]:
    base = home.rstrip("/")
    return [f"{base}/sessions"] + ([f"{base}/archived_sessions"] if include_archived else [])


def list_sources(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """One row per log file: path, size and modification time. File contents are not read."""
    out = None
    for root in roots:
        try:
            found = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.jsonl")
                .load(root)
                .select(plain_path(F.col("path")).alias("file"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("mtime"))
            )
        except AnalysisException as error:
            if not _missing(error):
                raise
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "file string, size long, mtime timestamp")
    return out


def read_rollouts(
    spark: SparkSession,
    roots: Iterable[str],
    account: str | Column = "default",
    modified_since: Column | None = None,
) -> DataFrame:
    """Lines of every `*.jsonl` below the roots, with an order that survives file splitting.

    Within a file, (block, ord) is the line order: a block is one split of the file and a split is
    read in order by one task. Blocks also bound the work of a task on one long file. ``account``
    may be a column over ``file``. A missing root is empty.
    """
    out = None
    for root in roots:
        try:
            raw = (
                spark.read.option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.jsonl")
                .text(root)
            )
        except AnalysisException as error:
            if not _missing(error):
                raise
            continue
        meta = F.col("_metadata")
        if modified_since is not None:
            raw = raw.filter(meta["file_modification_time"] >= modified_since)
        lines = raw.select(
            plain_path(meta["file_path"]).alias("file"),
            meta["file_block_start"].alias("block"),
            F.monotonically_increasing_id().alias("ord"),
            (meta["file_block_length"] < meta["file_size"]).alias("split"),
            "value",
        ).select(_account(account).alias(ACCOUNT), "*")
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        return spark.createDataFrame([], LINES_SCHEMA)
    return out


def lines_from_table(df: DataFrame, rows_per_block: int = 100_000) -> DataFrame:
    """Lines held in a table with (account_id, file, ord, value), cut into blocks of lines."""
    block = F.floor(F.col("ord") / F.lit(rows_per_block)).cast("long")
    return df.select(
        ACCOUNT, "file", block.alias("block"), F.col("ord").cast("long").alias("ord"),
        F.lit(True).alias("split"), "value",
    )


def thread_id_of_file(file: Column) -> Column:
    """The UUID ending the file name, else an id made from the path."""
    found = F.regexp_extract(file, THREAD_ID_AT_END, 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("file-"), hash_id(file)))


_TOKENS = (
    "struct<input_tokens double, cached_input_tokens double, cache_write_input_tokens double, "
    "output_tokens double, reasoning_output_tokens double, total_tokens double>"
)
_BUCKET = "struct<window_minutes double, used_percent double, resets_at double>"
# The parts of a record that matter. A structured `source` arrives as its JSON text.
RECORD_TYPE = (
    "struct<timestamp string, type string, payload struct<"
    "type string, id string, turn_id string, started_at double, model string, effort string, "
    "cwd string, source string, parent_thread_id string, forked_from_id string, "
    "git struct<repository_url string>, "
    "thread_settings struct<model string, reasoning_effort string, service_tier string>, "
    "call_id string, name string, namespace string, "
    f"info struct<total_token_usage {_TOKENS}, last_token_usage {_TOKENS}, "
    "model_context_window double>, "
    "rate_limits struct<limit_id string, limit_name string, plan_type string, "
    f"primary {_BUCKET}, secondary {_BUCKET}>>>"
)


def _usage(u: Column) -> Column:
    """The six token counts of a usage object, as struct<i, c, w, o, r, t>."""
    fields = {
        "i": "input_tokens", "c": "cached_input_tokens", "w": "cache_write_input_tokens",
        "o": "output_tokens", "r": "reasoning_output_tokens", "t": "total_tokens",
    }
    return F.struct(*[token_count(u[name]).alias(short) for short, name in fields.items()])


def _bucket(b: Column) -> Column:
    return F.struct(
        finite_number(b["window_minutes"]).cast("int").alias("window_minutes"),
        finite_number(b["used_percent"]).alias("used_percent"),
        finite_number(b["resets_at"]).cast("long").alias("resets_at"),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Typed records of the kinds that matter, plus one ``bad`` row per malformed line.

    Kinds: ``meta``, ``start``, ``turn``, ``settings``, ``call``, ``tokens``, ``bad``. Blank lines
    and other record types are dropped.
    """

    # One pass over the parsed line takes out everything at once. As generated columns, the line and
    # its parts are computed once: as plain ones, the filter on the kind below would be pushed under
    # the projection and repeat the parsing for every comparison.
    spawn = "$.payload.source.subagent.thread_spawn.parent_thread_id"
    keys = [ACCOUNT, "file", "block", "ord", "split"]
    head = (
        lines.filter(F.col("value").rlike(r"\S"))
        .select(*keys, F.explode(F.array(F.try_parse_json("value"))).alias("v"))
        .select(*keys, "v", F.explode(F.array(F.try_variant_get("v", "$", RECORD_TYPE))).alias("r"))
    )
    typ, ptype = F.col("r.type"), F.col("r.payload.type")
    bad = F.col("v").isNull() | F.is_variant_null("v")
    kind = (
        F.when(bad, "bad")
        .when(typ == "session_meta", "meta")
        .when((typ == "event_msg") & (ptype == "task_started"), "start")
        .when(typ == "turn_context", "turn")
        .when((typ == "event_msg") & (ptype == "thread_settings_applied"), "settings")
        .when((typ == "response_item") & ptype.isin(CALL_TYPES), "call")
        .when((typ == "event_msg") & (ptype == "token_count"), "tokens")
    )
    k, p = F.col("kind"), F.col("r.payload")
    kept = head.select(
        *keys, kind.alias("kind"), "r",
        F.when(typ == "session_meta", F.try_variant_get("v", spawn, "string")).alias("spawner"),
    ).filter(k.isNotNull())

    def text(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def only(kinds: str | list[str], c: Column) -> Column:
        return F.when(k.isin([kinds] if isinstance(kinds, str) else kinds), c)

    settings, limits, info = p["thread_settings"], p["rate_limits"], p["info"]
    tool = F.coalesce(text(p["name"]), text(p["namespace"]), p["type"])
    return kept.select(
        ACCOUNT, "file", "block", "ord", "split", "kind",
        only(["start", "tokens", "call"], text(F.col("r.timestamp"))).alias("at"),
        only(["start", "turn"], text(p["turn_id"])).alias("turn_id"),
        only("start", p["started_at"]).alias("started_at"),
        F.when(k == "turn", text(p["model"])).when(k == "settings", text(settings["model"]))
        .alias("set_model"),
        F.when(k == "turn", text(p["effort"]))
        .when(k == "settings", text(settings["reasoning_effort"])).alias("set_effort"),
        only(["meta", "turn"], text(p["cwd"])).alias("set_cwd"),
        only("settings", F.struct(
            text(F.btrim(F.coalesce(settings["service_tier"], F.lit(""))))
            .alias("tier"))).alias("set_tier"),
        only("meta", F.struct(
            text(p["id"]).alias("id"), text(p["git"]["repository_url"]).alias("git"),
            text(p["source"]).alias("source"),
            F.coalesce(text(p["parent_thread_id"]), text(p["forked_from_id"])).alias("parent"),
            text(F.col("spawner")).alias("spawner"),
        )).alias("meta"),
        only("call", F.struct(
            p["type"].alias("type"), tool.alias("name"),
            F.coalesce(text(p["call_id"]), text(p["id"])).alias("stable_id"),
        )).alias("call"),
        only("tokens", F.struct(
            _usage(info["total_token_usage"]).alias("total"),
            _usage(info["last_token_usage"]).alias("last"),
            token_count(info["model_context_window"]).alias("context_window"),
        )).alias("usage"),
        only("tokens", F.struct(
            F.coalesce(text(limits["limit_id"]), text(limits["limit_name"]), F.lit("anonymous"))
            .alias("limit"),
            text(limits["limit_name"]).alias("limit_name"),
            F.coalesce(text(limits["plan_type"]), F.lit("unknown")).alias("plan_type"),
            F.array(_bucket(limits["primary"]), _bucket(limits["secondary"])).alias("buckets"),
        )).alias("limits"),
    )
