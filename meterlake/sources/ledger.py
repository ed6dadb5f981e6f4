"""Stored ledgers: versioned Parquet tables behind a pointer, and JSON snapshots."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.numbers import safe_ts
from meterlake.keys import ACCOUNT
from meterlake.sources.rollouts import _account, _missing
from meterlake.storage import create_small, delete_folder, file_names, folder_names, read_small


class LedgerError(ValueError):
    """A ledger is missing or cannot be read."""


@dataclass(frozen=True)
class Ledger:
    events: DataFrame
    threads: DataFrame
    quota_observations: DataFrame
    coverage: DataFrame
    provenance: DataFrame


TABLES = ["events", "threads", "quota_observations", "coverage", "provenance"]


def write_table(df: DataFrame, path: str, by_date: bool = False) -> None:
    """Write one ledger table; events are stored by UTC date, in evenly sized files."""
    if by_date:
        dated = df.withColumn("event_date", F.to_date("ts"))
        # Rebalancing splits a date that holds much of the data and joins small ones.
        dated.hint("rebalance", F.col("event_date")).write.partitionBy("event_date").parquet(path)
    else:
        df.hint("rebalance").write.parquet(path)


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


class PublishConflict(RuntimeError):
    """Another writer has published since this one looked."""


def _newest_number(spark: SparkSession, path: str) -> int:
    names = file_names(spark, f"{path}/pointers")
    return max((int(n) for n in names if n.isdigit()), default=0)


def publish(
    spark: SparkSession, path: str, version: str, generated_at: datetime, after: int | None = None,
) -> int:
    """Make a fully written version the current one; returns its number.

    Pointers are numbered, and a number is taken by creating its file, which succeeds once. So no
    clock decides, and of two writers at a time one gets the next number. With ``after``, the number
    that the writer started from, the other one fails; without, it takes the number behind.
    """
    body = json.dumps({"version": version, "generated_at": _utc(generated_at).isoformat()})
    while True:
        number = (_newest_number(spark, path) if after is None else after) + 1
        if create_small(spark, f"{path}/pointers/{number:012d}", body):
            return number
        if after is not None:
            raise PublishConflict(f"Version {number} of {path.rstrip('/').split('/')[-1]} is taken.")


def newest_pointer(spark: SparkSession, path: str) -> tuple[int, str, datetime]:
    """Number, version and generation time of the current version."""
    number = _newest_number(spark, path)
    if not number:
        raise LedgerError(f"Ledger not found: {path.rstrip('/').split('/')[-1]}")
    found = json.loads(read_small(spark, f"{path}/pointers/{number:012d}"))
    return number, found["version"], datetime.fromisoformat(found["generated_at"])


def write_ledger(ledger: Ledger, path: str, generated_at: datetime) -> str:
    """Replace the stored ledger: readers see the old one until all tables are written."""
    spark = ledger.events.sparkSession
    version = uuid.uuid4().hex
    for name in TABLES:
        write_table(getattr(ledger, name), f"{path}/versions/{version}/{name}",
                    by_date=name == "events")
    publish(spark, path, version, generated_at)
    return version


def current_version(spark: SparkSession, path: str) -> tuple[str, datetime]:
    """Name and generation time of the current version."""
    _, version, generated_at = newest_pointer(spark, path)
    return version, generated_at


def remove_old_versions(spark: SparkSession, path: str) -> int:
    """Remove all versions but the current one; tells how many. Nothing may be reading or writing them."""
    try:
        current, _ = current_version(spark, path)
    except LedgerError:
        return 0
    old = [name for name in folder_names(spark, f"{path}/versions") if name != current]
    for name in old:
        delete_folder(spark, f"{path}/versions/{name}")
    return len(old)


def read_ledger(spark: SparkSession, path: str) -> Ledger:
    """The current version of a stored ledger."""
    version, _ = current_version(spark, path)
    base = f"{path}/versions/{version}"
    try:
        return Ledger(**{name: spark.read.parquet(f"{base}/{name}") for name in TABLES})
    except AnalysisException as error:
        raise LedgerError(f"Ledger is missing a table: {error.getCondition()}") from error


_EVENT = (
    "id string, timestamp string, threadId string, threadTitle string, project string, "
    "model string, effort string, source string, useType string, turnId string, "
    "toolCalls double, serviceTier string, inputTokens double, cachedInputTokens double, "
    "cacheWriteInputTokens double, outputTokens double, reasoningTokens double, "
    "totalTokens double, rateCardCredits double, breakdownAvailable boolean, dedupeQuality string"
)
_THREAD = (
    "id string, title string, project string, model string, effort string, source string, "
    "useType string, parentThreadId string, firstActiveAt string, lastActiveAt string, "
    "totalTokens double, detailedTokens double, unknownBreakdownTokens double, "
    "reportedCumulativeTokens double, inputTokens double, cachedInputTokens double, "
    "outputTokens double, reasoningTokens double, rateCardCredits double, ratedTokens double, "
    "toolCalls double, eventCount double, coverage string"
)
_QUOTA = (
    "id string, timestamp string, usedPercent double, windowMinutes double, resetsAt double, "
    "planType string, limitKey string, limitName string, source string, scope string, "
    "eventCutoffAt string"
)
_COVERAGE = (
    "filesScanned long, bytesScanned long, parseErrors long, duplicateEventsSkipped long, "
    "correctionIntervals long, observedTokens double, detailedTokens double, "
    "unknownBreakdownTokens double, stateCounterSumNonAdditive double, "
    "unresolvedThreadCounters long, legacyHeuristicEvents long, detailedPercent double, "
    "earliestEventAt string, latestEventAt string, completeSinceWindowStart boolean, "
    "notes array<string>"
)
_PROVENANCE = "kind string, privacy string, rateCardAsOf string, rateCardUrl string"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(":".join(f.split()) for f in fields.split(",")) + ">"


SNAPSHOT_SCHEMA = (
    "schemaVersion int, generatedAt string, label string, "
    f"provenance {_struct(_PROVENANCE)}, coverage {_struct(_COVERAGE)}, "
    f"events array<{_struct(_EVENT)}>, threads array<{_struct(_THREAD)}>, "
    f"quotaObservations array<{_struct(_QUOTA)}>"
)

_LONGS = {
    "toolCalls", "inputTokens", "cachedInputTokens", "cacheWriteInputTokens", "outputTokens",
    "reasoningTokens", "totalTokens", "detailedTokens", "unknownBreakdownTokens",
    "reportedCumulativeTokens", "ratedTokens", "eventCount", "resetsAt", "observedTokens",
    "stateCounterSumNonAdditive",
}
_TIMES = {"timestamp", "firstActiveAt", "lastActiveAt", "eventCutoffAt", "earliestEventAt",
          "latestEventAt"}


def _snake(name: str) -> str:
    special = {"timestamp": "ts"}
    if name in special:
        return special[name]
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _columns(prefix: str, fields: str) -> list:
    out = []
    for part in fields.split(","):
        name = part.split()[0]
        c = F.col(f"{prefix}.{name}")
        if name in _TIMES:
            c = safe_ts(c)
        elif name in _LONGS:
            c = c.cast("long")
        elif name == "windowMinutes":
            c = c.cast("int")
        out.append(c.alias(_snake(name)))
    return out


def read_snapshot_json(spark: SparkSession, path: str, account="default") -> Ledger:
    """Snapshots stored as JSON documents, one per file. ``account`` may be a column over `file`."""
    try:
        docs = spark.read.schema(
            SNAPSHOT_SCHEMA + ", _corrupt string"
        ).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as error:
        if _missing(error):
            raise LedgerError(
                f"Snapshot not found: {path.rstrip('/').split('/')[-1]}") from error
        raise
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    broken = docs.filter(F.col("events").isNull()).select("_corrupt").head(1)
    if broken:
        what = "Could not read snapshot" if broken[0][0] else "Snapshot is missing its events array"
        raise LedgerError(f"{what}: {path.rstrip('/').split('/')[-1]}")
    keyed = docs.select(_account(account).alias(ACCOUNT), "*")

    def items(name: str, fields: str, seen: bool) -> DataFrame:
        place = F.struct("file", F.lit(0).cast("long").alias("block"),
                         F.col("pos").cast("long").alias("ord"), F.lit(0).alias("part"))
        rows = keyed.select(ACCOUNT, "file", F.posexplode(name).alias("pos", "x"))
        extra = [place.alias("seen")] if seen else []
        return rows.select(ACCOUNT, *_columns("x", fields), *extra)

    return Ledger(
        events=items("events", _EVENT, True),
        threads=items("threads", _THREAD, False),
        quota_observations=items("quotaObservations", _QUOTA, True),
        coverage=keyed.filter("coverage is not null").select(
            ACCOUNT, *_columns("coverage", _COVERAGE)),
        provenance=keyed.select(
            ACCOUNT, F.col("schemaVersion").alias("schema_version"),
            safe_ts(F.col("generatedAt")).alias("generated_at"), "label",
            F.col("provenance.kind").alias("kind"), F.col("provenance.privacy").alias("privacy"),
            F.col("provenance.rateCardAsOf").alias("rate_card_as_of"),
            F.col("provenance.rateCardUrl").alias("rate_card_url")),
    )
