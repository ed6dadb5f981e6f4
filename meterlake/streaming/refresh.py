"""Incremental refresh: only changed log files are read again.

Stored are each file's context records, not winners, so that dropping a file's old records and
adding its new ones gives what a full rebuild would give. A manifest says which records are live.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.keys import ACCOUNT
from meterlake.plans.ingest import Metadata, build_ledger, context_records
from meterlake.sources.ledger import (
    LedgerError,
    current_version,
    publish,
    remove_old_versions,
    write_ledger,
)
from meterlake.sources.rollouts import _account, _missing, list_sources, read_rollouts
from meterlake.storage import Scratch, delete_folder, folder_names

_MANIFEST = "file string, size long, mtime timestamp, batch string"
_STATE = ["file", "size", "mtime"]


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    try:
        version, _ = current_version(spark, f"{store}/files")
    except LedgerError:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.parquet(f"{store}/files/versions/{version}")


def live_context(spark: SparkSession, store: str) -> DataFrame:
    """Context records of the current version of every file."""
    live = _manifest(spark, store).select("file", "batch")
    return spark.read.parquet(f"{store}/context").join(live, ["file", "batch"], "left_semi").drop(
        "batch")


def update_context(
    spark: SparkSession, roots: list[str], store: str, account: str | Column = "default"
) -> bool:
    """Read new and changed files, forget deleted ones. Tells whether anything changed."""
    listed = list_sources(spark, roots)
    known = _manifest(spark, store)
    same = known.join(listed, _STATE, "left_semi")
    touched = listed.join(known, _STATE, "left_anti")
    oldest = touched.agg(F.min("mtime")).first()[0]
    gone = known.join(listed, "file", "left_anti")
    if oldest is None and gone.isEmpty():
        return False
    batch = f"b{uuid.uuid4().hex}"
    if oldest is not None:
        # Files older than every touched one are skipped when the folder is listed.
        lines = read_rollouts(spark, roots, account, modified_since=F.lit(oldest))
        fresh = lines.join(touched.select("file"), "file", "left_semi")
        scratch = Scratch(spark, "records")
        context_records(fresh, scratch).withColumn("batch", F.lit(batch)).write.mode(
            "append").partitionBy("batch", "kind").parquet(f"{store}/context")
        scratch.clear()
    files = same.unionByName(touched.withColumn("batch", F.lit(batch)))
    files.write.parquet(f"{store}/files/versions/{batch}")
    publish(spark, f"{store}/files", batch, datetime.now(UTC))
    return True


def _fingerprint(spark: SparkSession, store: str, meta: Metadata) -> str | None:
    """The manifest's version with sizes and hashes of the metadata; none without any manifest."""
    try:
        version, _ = current_version(spark, f"{store}/files")
    except LedgerError:
        return None
    parts = [version]
    for table in (meta.titles, meta.state, meta.edges):
        row = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*table.columns))).first()
        parts += [str(row[0]), str(row[1])]
    return "-".join(parts)


def _built(spark: SparkSession, store: str) -> str | None:
    try:
        return current_version(spark, f"{store}/built")[0]
    except LedgerError:
        return None


def refresh(
    spark: SparkSession, roots: list[str], store: str, meta: Metadata,
    account: str | Column = "default", generated_at: datetime | None = None,
) -> bool:
    """Bring the stored ledger up to date with the logs and with titles, state and edges.

    The ledger is current if what it was built from is what there is now: a build that failed, and
    changed metadata, are made up for by the next call.
    """
    update_context(spark, roots, store, account)
    wanted = _fingerprint(spark, store, meta)
    if wanted is None or wanted == _built(spark, store):
        return False
    now = generated_at or datetime.now(UTC)
    sources = _manifest(spark, store).select(_account(account).alias(ACCOUNT), "file", "size")
    try:
        ctx = live_context(spark, store)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return False
    write_ledger(build_ledger(spark, ctx, sources, meta, now), f"{store}/ledger", now)
    publish(spark, f"{store}/built", wanted, now)
    return True


def clean_up(spark: SparkSession, store: str) -> int:
    """Remove what no current version needs: old ledgers and manifests, batches without live files.

    Call it when no refresh and no reader of an old version is at work. Returns how many folders went.
    """
    gone = remove_old_versions(spark, f"{store}/ledger") + remove_old_versions(spark, f"{store}/files")
    # One name per refresh that still has live files.
    live = {f"batch={row['batch']}" for row in _manifest(spark, store).select("batch").distinct().collect()}
    dead = [n for n in folder_names(spark, f"{store}/context") if n.startswith("batch=") and n not in live]
    for name in dead:
        delete_folder(spark, f"{store}/context/{name}")
    return gone + len(dead)


def refresh_stream(
    spark: SparkSession, root: str, store: str, meta: Metadata,
    account: str | Column = "default", on_done: Callable[[bool], None] = lambda changed: None,
) -> StreamingQuery:
    """Refresh whenever log files arrive, for all files there are now.

    The file source announces new files; each announcement also picks up files that grew. Appends
    alone are not announced, so call ``refresh`` on a schedule as well.
    """
    arrivals = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl").schema(
            "path string, modificationTime timestamp, length long, content binary")
        .load(root).select("path")
    )

    def run(_batch: DataFrame, _id: int) -> None:
        on_done(refresh(spark, [root], store, meta, account))

    return (
        arrivals.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{store}/arrivals")
        .trigger(availableNow=True).start()
    )
