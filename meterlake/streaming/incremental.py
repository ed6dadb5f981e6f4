"""Refresh that costs what changed: tails of files, winners by touched keys, events by touched dates.

1. Files whose size or time changed are looked at. One that still has its known last block, at its known end, grew,
   and only its tail is read, with the running context stored for it; any other is read whole and its old rows go.
2. New rows become candidates, stored in parts by a hash of the key among whose copies a winner is chosen
   (a call's turn, or its id without one; a tool call's key; a reading's limit, window, reset and use).
3. Winners are chosen again in the parts that new rows, or rows of files that went, touch.
4. Winners that differ from the old ones name the call groups, threads and dates whose events and threads
   are made anew. Nothing else is read beyond key columns, and nothing else is written.

All tables change in one step (see `parts`). The five tables equal those of a full rebuild.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.models import RATE_CARD, Rate
from meterlake.keys import ACCOUNT
from meterlake.operators import assemble as A
from meterlake.operators import context as C
from meterlake.operators import dedupe as D
from meterlake.plans.ingest import Metadata
from meterlake.sources.ledger import Ledger, LedgerError
from meterlake.sources.rollouts import _account, list_sources, parse_records
from meterlake.sources.tail import inspect_files, read_ranges
from meterlake.storage import Scratch
from meterlake.streaming.parts import PART, Parts, part_of

#: Parts of each table of a new store. A part is what a touched key makes be written again.
PARTS = 64
FILE = [ACCOUNT, "file"]
ID = [ACCOUNT, "id"]
GROUP = [ACCOUNT, "call_group"]
THREAD = [ACCOUNT, "thread_id"]


def _together(*steps: Callable) -> list:
    """Results of steps that do not depend on each other; their jobs run side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


def _touched(*frames: DataFrame) -> set[str]:
    """Parts named by some rows: at most as many as there are parts."""
    return {row[PART] for row in reduce(DataFrame.union, [f.select(PART) for f in frames]).distinct().collect()}


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def _only(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def _differing(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the old and of the new table that have no equal row of the same key in the other one."""
    mark = F.xxhash64(*old.columns).alias("mark")
    a, b = old.withColumn("mark", mark), new.select(*old.columns).withColumn("mark", mark)
    on = [*keys, "mark"]
    return (a.join(b.select(*on), on, "left_anti").drop("mark"), b.join(a.select(*on), on, "left_anti").drop("mark"))


def _group() -> Column:
    return A.call_group(F.col("turn"), F.col("thread_id")).alias("call_group")


class _Change:
    """One refresh: what is there, what changed, and the tables that follow from it."""

    def __init__(self, spark: SparkSession, parts: Parts, scratch: Scratch):
        self.spark, self.parts, self.scratch = spark, parts, scratch
        self.name = f"c{uuid.uuid4().hex}"
        self.n = int(parts.settings["parts"])
        self.nothing_gone = True

    # ---- Reading and writing parts

    def old(self, table: str, like: DataFrame, touched: set[str] | None = None) -> DataFrame:
        """Stored rows of a table, or an empty table of the columns of `like`."""
        if table not in self.parts.schemas:
            return self.spark.createDataFrame([], like.drop(PART).schema)
        return self.parts.read(table, touched)

    def put(self, table: str, rows: DataFrame, key: Column, touched: set[str]) -> None:
        self.parts.replace(table, rows.withColumn(PART, key), self.name, touched)

    def with_old(self, table: str, new: DataFrame, key: Column, gone: DataFrame) -> tuple[DataFrame, set[str]]:
        """The content of the parts that new rows or vanished files touch, and which parts these are."""
        frames = [new.select(key)]
        if not self.nothing_gone:
            frames.append(_only(self.old(table, new).select(*FILE, key), gone, FILE))
        touched = _touched(*frames)
        kept = _without(self.old(table, new, touched), gone, FILE)
        return kept.unionByName(new), touched

    # ---- Files

    def files(self, roots: list[str], account: str | Column, compare: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All files as they are now, the ranges to read, and the files whose stored rows must go."""
        empty = self.spark.createDataFrame([], f"{ACCOUNT} string, file string, size long, mtime timestamp, end long, mark string")
        known = self.old("files", empty)
        listed = list_sources(self.spark, roots)
        was = known.select("file", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"),
                           F.col("end").alias("known_end"), F.col("mark").alias("old_mark"))
        both = listed.join(was, "file", "left")
        same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
        moved = both.filter(F.lit(compare) | ~F.coalesce(same, F.lit(False)))
        seen = self.scratch.store(inspect_files(moved).withColumn(ACCOUNT, _account(account)), "seen")
        grew = F.coalesce((F.col("known_mark") == F.col("old_mark")) & (F.col("end") >= F.col("known_end")), F.lit(False))
        ranges = seen.select(ACCOUNT, "file", F.when(grew, F.col("known_end")).otherwise(0).alias("start"), "end").filter("end > start")
        lost = known.join(listed, "file", "left_anti").select(*FILE)
        gone = lost.unionByName(seen.filter(F.col("old_mark").isNotNull() & ~grew).select(*FILE))
        now = _without(known, lost, ["file"]).join(seen.select("file"), "file", "left_anti").unionByName(
            seen.select(ACCOUNT, "file", "size", "mtime", "end", "mark"))
        return self.scratch.store(now, "files"), self.scratch.store(ranges, "ranges"), self.scratch.store(gone, "gone")

    # ---- Candidates

    def take_in(self, ranges: DataFrame, gone: DataFrame) -> dict[str, set[str]]:
        """Read the ranges and bring all candidates up to date; tells the touched parts of each kind."""
        n, by_file = self.n, part_of(self.n, ACCOUNT, "file")
        records = self.scratch.store(parse_records(read_ranges(ranges)), "records")
        resumed = ranges.filter("start > 0")
        self.nothing_gone = gone.isEmpty()
        fresh = C.file_state(records)
        before = self.scratch.store(_only(self.old("state", fresh), resumed, FILE), "before")
        ctx = self.scratch.store(C.with_context(records, before), "context", ["kind"])
        touched = {}

        # Of a file that grew, the stored state is replaced by the new one.
        state = C.file_state(records, before)
        rows, at = self.with_old("state", state, by_file, gone.unionByName(resumed.select(*FILE)))
        self.put("state", rows, by_file, at)

        series = self.old("series", self._series(C.call_records(ctx)))
        calls = C.call_records(ctx, _only(series, resumed, FILE).select(*C.CALL_SERIES, "ordinal"))
        calls = self.scratch.store(calls, "tools").withColumn("key", D.tool_key())
        content, at = self.with_old("series", self._series(calls), by_file, gone)
        self.put("series", content.groupBy(*C.CALL_SERIES).agg(F.max("ordinal").alias("ordinal")), by_file, at)
        tokens = C.token_records(ctx).withColumn("key", D.call_key()).withColumn("id", D.call_id(F.col("key")))
        kinds = {
            "call_copies": (tokens, part_of(n, ACCOUNT, F.coalesce("turn", "id"))),
            "turn_parts": (C.turn_parts(ctx), part_of(n, ACCOUNT, "own_turn")),
            "tool_copies": (calls, part_of(n, ACCOUNT, "key")),
            "quota_copies": (C.quota_records(ctx), part_of(n, ACCOUNT, "limit_key", "window_minutes", "resets_at", "used_percent")),
            "parents": (C.parent_candidates(ctx), by_file),
            "counters": (C.file_counters(ctx), by_file),
        }

        def bring(table: str, new: DataFrame, key: Column) -> None:
            content, touched[table] = self.with_old(table, new, key, gone)
            if table == "turn_parts":
                content = C.merge_turn_parts(content)
            if table == "counters":
                content = content.groupBy(*FILE).agg(F.sum("parse_errors").alias("parse_errors"), F.sum("correction_intervals").alias("correction_intervals"))
            self.put(table, content, key, touched[table])

        _together(*[partial(bring, table, new, key) for table, (new, key) in kinds.items()])
        return touched

    @staticmethod
    def _series(calls: DataFrame) -> DataFrame:
        return calls.groupBy(*C.CALL_SERIES).agg(F.max("ordinal").alias("ordinal"))

    # ---- Winners

    def choose(self, touched: dict[str, set[str]]) -> tuple[list[DataFrame], list[DataFrame]]:
        """Winners of the touched parts; returns the calls and the tool calls that differ from before."""
        n, read = self.n, self.parts.read
        # Calls and origins of a turn lie in parts of the same number.
        turns = touched["call_copies"] | touched["turn_parts"]
        origins = D.turn_origins(C.settled_turns(read("turn_parts", turns)))
        by_turn = part_of(n, ACCOUNT, "turn")
        calls = A.attribute(D.dedupe_calls(read("call_copies", turns)), origins)
        tools = D.dedupe_tool_calls(read("tool_copies", touched["tool_copies"]))
        quota = D.dedupe_quota(read("quota_copies", touched["quota_copies"]))
        old_calls, old_tools = self.old("calls", calls, turns), self.old("tools", tools, touched["tool_copies"])
        by_reading = part_of(n, ACCOUNT, "limit_key", "window_minutes", "resets_at", "used_percent")
        _together(partial(self.put, "origins", origins, by_turn, turns),
                  partial(self.put, "calls", calls, part_of(n, ACCOUNT, F.coalesce("turn", "id")), turns),
                  partial(self.put, "tools", tools, part_of(n, ACCOUNT, "key"), touched["tool_copies"]),
                  partial(self.put, "quota", quota, by_reading, touched["quota_copies"]))
        calls_now, tools_now = read("calls", turns), read("tools", touched["tool_copies"])
        pairs = [*_differing(old_calls, calls_now, ID), *_differing(old_tools, tools_now, [ACCOUNT, "key"])]
        stored = _together(*[partial(self.scratch.store, d, "differing") for d in pairs])
        return stored[:2], stored[2:]

    # ---- Ledger tables

    def assemble(self, calls: list[DataFrame], tools: list[DataFrame], meta: Metadata, rates: dict[str, Rate]) -> None:
        read = self.parts.read
        facts = self.scratch.store(A.thread_facts(meta.state, meta.titles, D.thread_parents(meta.edges, read("parents"))), "facts")
        by_thread = part_of(self.n, *THREAD)
        facts_differ = _together(*[partial(self.scratch.store, d, "facts") for d in _differing(self.old("facts", facts), facts, THREAD)])
        threads = reduce(DataFrame.union, [d.select(*THREAD) for d in [*facts_differ, *calls]]).distinct()
        threads = self.scratch.store(threads, "threads")
        in_thread = _only(read("calls").select(ACCOUNT, "turn", "thread_id"), facts_differ[0].union(facts_differ[1]), THREAD)
        groups = reduce(DataFrame.union, [d.select(ACCOUNT, _group()) for d in [*calls, *tools, in_thread]]).distinct()
        groups = self.scratch.store(groups, "groups")
        wanted = self.scratch.store(read("calls").select(ACCOUNT, "id", "turn", _group()).join(groups, GROUP, "left_semi")
                                    .select(*ID, part_of(self.n, ACCOUNT, F.coalesce("turn", "id"))), "wanted")
        # Only parts of calls with an affected group are read whole.
        affected = _only(read("calls", _touched(wanted)), wanted, ID)
        counted = read("tools").select(ACCOUNT, "turn", "thread_id", _group()).join(groups, GROUP, "left_semi")
        priced = self.scratch.store(A.price_events(affected, facts, rates), "priced")
        events = self.scratch.store(A.attach_tool_calls(priced, counted), "events")

        day = F.to_date("ts").cast("string").alias(PART)
        old_events = self.old("events", events)
        event_group = A.call_group(F.col("turn_id"), F.col("thread_id")).alias("call_group")
        went = old_events.select(ACCOUNT, "ts", event_group).join(groups, GROUP, "left_semi")
        days = _touched(went.select(day), events.select(day))
        kept = self.old("events", events, days).withColumn("call_group", event_group).join(groups, GROUP, "left_anti").drop("call_group")
        self.put("events", kept.unionByName(events), day, days)

        # Threads whose events, facts or origins changed; their events are found by key columns.
        threads = self.scratch.store(threads.union(events.select(*THREAD)).distinct(), "threads")
        mine = _only(read("events"), threads, THREAD)
        rolled = A.rollup_threads(mine, _only(facts, threads, THREAD), read("origins"))
        of_id = part_of(self.n, ACCOUNT, "id")
        touched = _touched(threads.select(by_thread))
        same = self.old("threads", rolled, touched).join(threads.withColumnRenamed("thread_id", "id"), ID, "left_anti")
        self.put("threads", same.unionByName(rolled), of_id, touched)
        changed_facts = _touched(*[d.select(by_thread) for d in facts_differ])
        self.put("facts", facts.withColumn(PART, by_thread).filter(F.col(PART).isin(list(changed_facts))).drop(PART), by_thread, changed_facts)

    def cover(self, files: DataFrame, generated_at: datetime) -> None:
        """The small tables, whole: a row per account, and one row."""
        read, one = self.parts.read, F.lit("0").alias(PART)
        cover = A.coverage(files, read("counters"), read("calls"), read("events"), read("threads"), read("quota"))
        self.put("coverage", cover, one, {"0"})
        self.put("provenance", A.provenance(self.spark, generated_at), one, {"0"})


def refresh_changed(
    spark: SparkSession, roots: list[str], store: str, meta: Metadata, account: str | Column = "default",
    generated_at: datetime | None = None, compare: bool = False, parts: int = PARTS, rates: dict[str, Rate] = RATE_CARD,
) -> bool:
    """Bring a store up to date with its logs and metadata; tells whether anything had changed.

    ``account`` may be a column over ``file``. ``compare`` looks at the last block of every file, so that a rewrite
    within one tick of the store's clock is seen too. ``parts`` counts for a new store only. Lines are taken
    once their line feed is written. If another writer publishes meanwhile, ``PublishConflict`` is raised and the
    store stays as the other left it.
    """
    held = Parts.open(spark, store)
    held.settings.setdefault("parts", str(parts))
    scratch = Scratch(spark, "refresh")
    change = _Change(spark, held, scratch)
    try:
        files, ranges, gone = change.files(roots, account, compare)
        known = held.settings.get("metadata")
        metadata = _metadata_mark(meta)
        if ranges.isEmpty() and gone.isEmpty() and known == metadata:
            return False
        touched = change.take_in(ranges, gone)
        calls, tools = change.choose(touched)
        change.assemble(calls, tools, meta, rates)
        now = generated_at or datetime.now(UTC)
        change.cover(files, now)
        by_file = part_of(change.n, "file")
        differ = _differing(change.old("files", files), files, ["file"])
        at = _touched(*[d.select(by_file) for d in differ])
        change.put("files", files.withColumn(PART, by_file).filter(F.col(PART).isin(list(at))).drop(PART), by_file, at)
        held.settings["metadata"] = metadata
        held.publish(change.name, now)
        return True
    finally:
        scratch.clear()


def _metadata_mark(meta: Metadata) -> str:
    """Sizes and hashes of titles, state and edges."""
    marks = []
    for table in (meta.titles, meta.state, meta.edges):
        row = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*table.columns))).first()
        marks += [str(row[0]), str(row[1])]
    return "-".join(marks)


def read_store(spark: SparkSession, store: str) -> Ledger:
    """The five ledger tables of a store's current version."""
    held = Parts.open(spark, store)
    if "events" not in held.schemas:
        raise LedgerError(f"Ledger not found: {store.rstrip('/').split('/')[-1]}")
    return Ledger(events=held.read("events"), threads=held.read("threads"), quota_observations=held.read("quota"),
                  coverage=held.read("coverage"), provenance=held.read("provenance"))


__all__ = ["PARTS", "read_store", "refresh_changed"]
