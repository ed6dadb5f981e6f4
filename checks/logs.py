"""The derived log as real files that grow, and queries of what reads them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sample as S
from meterlake.operators import context as C
from meterlake.plans.ingest import Metadata, context_records
from meterlake.sources.ledger import Ledger
from meterlake.sources.metadata import TITLES_SCHEMA, thread_state
from meterlake.sources.rollouts import parse_records
from meterlake.sources.tail import stream_lines
from meterlake.storage import Scratch
from meterlake.streaming.incremental import read_store, refresh_changed


def no_metadata(spark: SparkSession) -> Metadata:
    state, edges = thread_state(spark)
    return Metadata(spark.createDataFrame([], TITLES_SCHEMA), state, edges)


def account_of_file() -> Column:
    """The sample's account of a log file: its user's number, modulo 3."""
    user = F.regexp_extract("file", r"([0-9]{12})\.jsonl$", 1).cast("long")
    return F.concat(F.lit("a"), (user % 3).cast("string"))


def write_logs(lines: DataFrame, folder: str, start: float, end: float) -> int:
    """Append to each log file the bytes between two shares of its whole text, however lines are cut by that.

    Files are written by tasks into a folder that all executors and the driver share.
    """
    base = folder.removeprefix("file://").removeprefix("file:")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        rows = (row for batch in batches for row in zip(batch["file"], batch["value"]))
        written = 0
        for file, part in groupby(rows, itemgetter(0)):
            text = ("\n".join(value for _, value in part) + "\n").encode()
            path = f"{base}/{file.rsplit('/', 1)[-1]}"
            os.makedirs(base, exist_ok=True)
            first, last = round(len(text) * start), round(len(text) * end)
            # At the offset, not at the end: a task that is run twice writes the same bytes to the same place.
            with open(path, "r+b" if os.path.exists(path) else "wb") as f:
                f.seek(first)
                f.write(text[first:last])
            written += last - first
        yield pd.DataFrame({"bytes": [written]})

    # Each file's lines are together, in one order whenever they are written.
    ordered = lines.select("file", "ord", "value").repartition("file")
    ordered = ordered.sortWithinPartitions("file", F.asc_nulls_last("ord"), "value")
    return ordered.mapInPandas(write, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def numbered(lines: DataFrame) -> DataFrame:
    """(file name, ord, line number) of lines in order."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("block", "ord")
    return lines.select("file", "ord", F.row_number().over(order).alias("line_no"))


def streamed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of records that arrived as a stream: files half written, a restart, then the rest."""
    scratch = Scratch(spark, "stream")
    lines = scratch.store(S.log_lines(spark, sf_dir), "lines")
    folder, sink, marks = (scratch.path(n) for n in ("sessions", "sink", "marks"))
    for start, end in ((0.0, 0.55), (0.55, 1.0)):
        write_logs(lines, folder, start, end)
        query = (stream_lines(spark, folder.removeprefix("file://")).writeStream.format("parquet")
                 .option("checkpointLocation", marks).trigger(availableNow=True).start(sink))
        query.awaitTermination()
    arrived = spark.read.parquet(sink).select(account_of_file().alias("account_id"), "file", "block", "ord", F.lit(True).alias("split"), "value")
    ctx = context_records(arrived, scratch).join(numbered(arrived), ["file", "ord"])
    out = ctx.select("account_id", F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", "kind", "model", "effort", "cwd",
                     "service_tier", "turn", "original_likely")
    return scratch.release(out)


def resumed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each file's first part, and of its tail with the state that the first part left."""
    scratch = Scratch(spark, "resumed")
    lines = S.log_lines(spark, sf_dir).select(
        "account_id", "file", F.expr("ord div 2000").alias("block"), "ord", F.lit(True).alias("split"), "value")
    records = scratch.store(parse_records(lines), "records")
    # Every file is cut somewhere else.
    cut = F.pmod(F.xxhash64("file"), F.lit(10_000))
    head, tail = records.filter(F.col("ord") < cut), records.filter(F.col("ord") >= cut)
    state = scratch.store(C.file_state(head), "state")
    both = C.with_context(head).unionByName(C.with_context(tail, state))
    return scratch.release(both.select("account_id", "file", "ord", "kind", "model", "effort", "cwd", "service_tier", "turn", "original_likely"))


def refreshed_ledger(spark: SparkSession, sf_dir: str, now: datetime) -> tuple[Ledger, Scratch]:
    """The ledger of a store that was refreshed as its files grew."""
    scratch = Scratch(spark, "refreshed")
    lines = scratch.store(S.log_lines(spark, sf_dir), "lines")
    folder, store = scratch.path("sessions"), scratch.path("store")
    for start, end in ((0.0, 0.6), (0.6, 1.0)):
        write_logs(lines, folder, start, end)
        refresh_changed(spark, [folder], store, no_metadata(spark), account_of_file(), now, parts=8)
    return read_store(spark, store), scratch
