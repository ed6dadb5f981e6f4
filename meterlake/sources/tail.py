"""Growing log files: whole lines of byte ranges, in batch and as a stream.

A line is placed by the byte at which it begins, so its position does not depend on when it was read: `block` is the
number of its file's stretch of `BLOCK_BYTES` and `ord` the line's first byte. A range ends behind a line feed; a
line that its writer has not finished is left for later.

The stream source `growing_lines` keeps a map of bytes read per file as its offset. New files and appended lines
arrive once, across restarts; a file that shrank or is gone starts anew when it comes back, so files that are
rewritten belong to `refresh`, which compares contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from meterlake.keys import ACCOUNT

#: Bytes of a block, which is also what a task reads of a file at a time, and of the end of a file that is compared.
BLOCK_BYTES = 32 << 20
MARK_BYTES = 4096
#: What opening a file counts for, in bytes, when small ranges share a task.
OPEN_BYTES = 64 << 10
_LINES = "file string, block long, ord long, value string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Store and path within it; plain paths are local or mounted ones."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe=":/%"))
    return fs.LocalFileSystem(), path


def _line_feed_before(f, end: int, step: int = 1 << 16) -> int:
    """Byte behind the last line feed before `end`; 0 if there is none."""
    while end > 0:
        begin = max(0, end - step)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def whole_lines(path: str, size: int) -> int:
    """How many of a file's first `size` bytes are finished lines."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        return _line_feed_before(f, min(size, f.size()))


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the lines that begin in [start, end).

    A line that began before `start` is passed over, and the last one is read to its end, so neighbouring ranges
    share no line and lose none.
    """
    store, name = _open(path)
    with store.open_input_file(name) as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1
        rest, skipping = b"", start > 0
        while True:
            data = f.read(1 << 20)
            if not data:
                break
            rest += data
            pieces = rest.split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                if not skipping and at < end:
                    yield at, piece.removesuffix(b"\r").decode("utf-8", "replace")
                skipping = False
                at += len(piece) + 1
            if at >= end:
                return
        # The file ends without a line feed: its last line is not finished.


def read_ranges(ranges: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines of `ranges` (account_id, file, start, end), both ends behind a line feed: one task step per block."""
    first, last = F.expr(f"start div {block_bytes}"), F.expr(f"(end - 1) div {block_bytes}")
    blocks = (ranges.filter("end > start").withColumn("block", F.explode(F.sequence(first, last)))
              .select(ACCOUNT, "file", "block",
                      F.greatest("start", F.col("block") * block_bytes).alias("start"),
                      F.least("end", (F.col("block") + 1) * block_bytes).alias("end")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for account, file, block, start, end in batch.itertuples(index=False, name=None):
                rows: list[tuple[int, str]] = []
                for line in lines_between(file, start, end):
                    rows.append(line)
                    if len(rows) == 10_000:
                        yield _rows(account, file, block, rows)
                        rows = []
                if rows:
                    yield _rows(account, file, block, rows)

    spread = blocks.repartition(F.col("file"), F.col("block"))
    lines = spread.mapInPandas(read, f"{ACCOUNT} string, {_LINES}")
    return lines.select(ACCOUNT, "file", "block", "ord", F.lit(True).alias("split"), "value")


def _rows(account: str, file: str, block: int, lines: list[tuple[int, str]]) -> pd.DataFrame:
    at, text = zip(*lines)
    return pd.DataFrame({ACCOUNT: account, "file": file, "block": block, "ord": at, "value": text})


def inspect_files(files: DataFrame) -> DataFrame:
    """`files` (file, size, and known_end, which may be null) with `end`, `mark` and `known_mark`.

    `end` is where finished lines end; `mark` a hash of the last bytes before `end`, and `known_mark` one of
    those before `known_end`, null if the file is shorter. A file that grew has the mark it had.
    """
    def mark(f, end: int) -> str:
        begin = max(0, end - MARK_BYTES)
        f.seek(begin)
        return hashlib.sha256(f.read(end - begin)).hexdigest()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, size, known in zip(batch["file"], batch["size"], batch["known_end"]):
                store, name = _open(file)
                with store.open_input_file(name) as f:
                    end = _line_feed_before(f, min(int(size), f.size()))
                    out.append((end, mark(f, end), mark(f, int(known)) if pd.notna(known) and known <= f.size() else None))
            yield batch.assign(**{c: [row[i] for row in out] for i, c in enumerate(("end", "mark", "known_mark"))})

    extra = "end long, mark string, known_mark string"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in files.schema), extra])
    return files.repartition("file").mapInPandas(look, schema)


class _Ranges(InputPartition):
    """(file, start, end) of what one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _packed(ranges: list[tuple[str, int, int]], block: int, tasks: int) -> list[_Ranges]:
    """Ranges dealt out in their order, up to a block for each task, and less than that if it takes fewer tasks than `tasks`."""
    costs = [end - start + OPEN_BYTES for _, start, end in ranges]
    most = min(block, -(-sum(costs) // tasks))
    out, room = [], 0
    for one, cost in zip(ranges, costs):
        if cost > room:
            out.append(_Ranges([]))
            room = most
        out[-1].ranges.append(one)
        room -= cost
    return out


class GrowingLinesReader(DataSourceStreamReader):
    """Offsets are maps of finished bytes per file, so the driver lists the folder once per micro-batch."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.block = int(options.get("blockBytes", BLOCK_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, base = _open(self.path)
        prefix = self.path[: len(self.path) - len(base.rstrip("/"))] if self.path.endswith(base.rstrip("/")) else ""
        found = {}
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(".jsonl"):
                continue
            if any(part.startswith((".", "_")) for part in info.path[len(base):].split("/")):
                continue
            name = prefix + info.path
            size, end = self.known.get(name, (-1, 0))
            if size != info.size:
                end = whole_lines(name, info.size)
                self.known[name] = (info.size, end)
            if end:
                found[name] = end
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for file, last in end.items():
            first = start.get(file, 0)
            first = first if first <= last else 0
            while first < last:
                stop = min(last, (first // self.block + 1) * self.block)
                ranges.append((file, first, stop))
                first = stop
        # Spark asks for one partition at least.
        return _packed(ranges, self.block, self.tasks) or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        for file, start, end in partition.ranges:
            for at, text in lines_between(file, start, end):
                yield file, start // self.block, at, text

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the files are the log's own."""


class GrowingLines(DataSource):
    """Stream of (file, block, ord, value); options: path, blockBytes, tasks (about as many at least)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return _LINES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingLinesReader(self.options)


def stream_lines(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A stream of the lines below `root`, those appended later included."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(GrowingLines.name()).option("blockBytes", str(block_bytes))
    return reader.option("tasks", str(spark.sparkContext.defaultParallelism)).load(root)


__all__ = ["BLOCK_BYTES", "GrowingLines", "inspect_files", "lines_between", "read_ranges", "stream_lines", "whole_lines"]
