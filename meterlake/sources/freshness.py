"""How old a ledger is and whether its sources have moved on."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.ledger import LedgerError, current_version
from meterlake.sources.rollouts import _missing, list_sources

CACHE_MAX_AGE = timedelta(hours=1)


def latest_source_time(
    spark: SparkSession, roots: Iterable[str], metadata_files: Iterable[str] = ()
) -> datetime | None:
    """Newest modification time over the logs and metadata files that exist."""
    found = list_sources(spark, roots).select("mtime")
    for path in metadata_files:
        try:
            found = found.unionByName(spark.read.format("binaryFile").load(path).select(
                F.col("modificationTime").alias("mtime")))
        except AnalysisException as error:
            if not _missing(error):
                raise
    return found.agg(F.max("mtime")).first()[0]


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


def cache_is_fresh(generated_at: datetime, now: datetime) -> bool:
    """Younger than an hour; a time in the future is not fresh."""
    age = _utc(now) - _utc(generated_at)
    return timedelta(0) <= age < CACHE_MAX_AGE


def needs_refresh(
    spark: SparkSession, path: str, roots: Iterable[str], now: datetime,
    metadata_files: Iterable[str] = (), explicit: bool = False, auto_refresh: bool = True,
    force: bool = False,
) -> bool:
    """Whether to rebuild the ledger at ``path`` before reading it.

    A ledger named explicitly, or with refreshing off, is only read. A ledger younger than an hour
    is used as it is; an older one is rebuilt if any source is strictly newer.
    """
    if force:
        return True
    try:
        _, generated_at = current_version(spark, path)
    except LedgerError:
        if explicit or not auto_refresh:
            raise
        return True
    if explicit or not auto_refresh or cache_is_fresh(generated_at, now):
        return False
    newest = latest_source_time(spark, roots, metadata_files)
    return newest is not None and _utc(newest) > _utc(generated_at)


def freshness(generated_at: Column, now: datetime) -> list[Column]:
    """Columns ``status`` (fresh, stale, unknown) and ``age_label``."""
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(generated_at)
    known = age >= 0
    minutes = F.floor(age / 60_000)
    label = (
        F.when(age < 60_000, "now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m old")))
        .when(minutes < 1_440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h old")))
        .otherwise(F.concat(F.floor(minutes / 1_440).cast("string"), F.lit("d old")))
    )
    status = F.when(age < int(CACHE_MAX_AGE.total_seconds() * 1_000), "fresh").otherwise("stale")
    return [
        F.when(known, status).otherwise("unknown").alias("status"),
        F.when(known, label).otherwise("age unknown").alias("age_label"),
    ]


def ledger_freshness(provenance: DataFrame, now: datetime) -> DataFrame:
    return provenance.select("*", *freshness(F.col("generated_at"), now))
