"""Thread titles, thread state and spawn edges."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import SPACES
from meterlake.functions.numbers import safe_ts
from meterlake.keys import ACCOUNT
from meterlake.sources.rollouts import _account, _missing

TITLES_SCHEMA = f"{ACCOUNT} string, thread_id string, session_title string"
STATE_SCHEMA = (
    f"{ACCOUNT} string, id string, created_at double, updated_at double, source string, "
    "cwd string, title string, name string, tokens_used double, git_sha string, "
    "git_branch string, git_origin_url string, agent_nickname string, agent_role string, "
    "model string, reasoning_effort string, thread_source string"
)
#: ``position`` is the row's place in its source; of one child's edges the last one counts.
EDGES_SCHEMA = (
    f"{ACCOUNT} string, parent_thread_id string, child_thread_id string, position long")


def titles_from_lines(lines: DataFrame) -> DataFrame:
    """Latest title per thread; on equal times the later line wins. Bad lines are ignored."""
    def text(path: str) -> Column:
        return F.nullif(F.try_variant_get("v", path, "string"), F.lit(""))

    rows = lines.withColumn("v", F.try_parse_json("value")).select(
        ACCOUNT, "block", "ord",
        text("$.id").alias("thread_id"),
        F.regexp_replace(text("$.thread_name"), SPACES, " ").alias("title"),
        text("$.updated_at").alias("updated_at"),
    ).filter("thread_id is not null and title is not null")
    epoch = F.timestamp_millis(F.lit(0))
    at = F.when(F.col("updated_at").isNull(), epoch).otherwise(safe_ts(F.col("updated_at")))
    return rows.groupBy(ACCOUNT, "thread_id").agg(
        F.max_by("title", F.struct(at, F.col("block"), F.col("ord"))).alias("session_title")
    )


def read_titles(spark: SparkSession, path: str, account: str | Column = "default") -> DataFrame:
    """Titles from a session index; a missing index is empty."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], TITLES_SCHEMA)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        "value",
    ).select(_account(account).alias(ACCOUNT), "*")
    return titles_from_lines(lines)


def _conform(df: DataFrame, schema: str) -> DataFrame:
    columns = {c.lower() for c in df.columns}
    picked = []
    for part in schema.split(","):
        name, kind = part.split()
        if name in columns:
            picked.append(F.col(name).cast(kind).alias(name))
        else:
            fill = F.lit("default") if name == ACCOUNT else F.lit(None)
            picked.append(fill.cast(kind).alias(name))
    return df.select(*picked)


def thread_state(
    spark: SparkSession, threads: DataFrame | None = None, edges: DataFrame | None = None,
    legacy_threads: DataFrame | None = None, legacy_edges: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """State and spawn-edge tables in the library's schema.

    The preferred location is used whole when it is there, else the legacy one, else both are empty.
    """
    if threads is None:
        threads, edges = legacy_threads, legacy_edges
    state = spark.createDataFrame([], STATE_SCHEMA) if threads is None else _conform(
        threads, STATE_SCHEMA)
    links = spark.createDataFrame([], EDGES_SCHEMA) if edges is None else _conform(
        edges, EDGES_SCHEMA)
    return state, links
