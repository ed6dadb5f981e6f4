"""Refresh by touched keys against full rebuilds; tails of files; the stream of growing files."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.logs import write_logs
from meterlake.operators import context as C
from meterlake.plans.ingest import Metadata, ingest
from meterlake.sources.ledger import LedgerError, PublishConflict
from meterlake.sources.metadata import EDGES_SCHEMA, STATE_SCHEMA, TITLES_SCHEMA
from meterlake.sources.rollouts import list_sources, parse_records, read_rollouts, thread_id_of_file
from meterlake.sources.tail import GrowingLinesReader, lines_between, read_ranges, stream_lines, whole_lines
from meterlake.storage import Scratch
from meterlake.streaming.incremental import read_store, refresh_changed
from meterlake.streaming.parts import Parts

NOW = datetime(2026, 8, 20, tzinfo=UTC)
BASE = datetime(2026, 8, 1, tzinfo=UTC)
TABLES = ["events", "threads", "quota_observations", "coverage", "provenance"]


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """Tiny tables and many plans: compiling them would be most of the time."""
    own = {"spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def thread(i):
    return f"{i:08d}-1111-4111-8111-111111111111"


class Log:
    """Random session logs that can be extended line by line; forks copy lines of other files."""

    def __init__(self, root, seed):
        self.root, self.r, self.lines = str(root), random.Random(seed), {}
        os.makedirs(f"{root}/sessions")

    def path(self, i):
        return f"{self.root}/sessions/rollout-{thread(i)}.jsonl"

    def record(self, i, n):
        r = self.r
        at = BASE + timedelta(hours=7 * n, minutes=i, seconds=r.randrange(50))
        stamp = at.strftime("%Y-%m-%dT%H:%M:%SZ")
        turn = f"t{i}-{n // 6}"
        count = 16 * r.randrange(1, 60)
        usage = {"input_tokens": count, "cached_input_tokens": count // 4, "output_tokens": 16, "total_tokens": count + 16}
        payloads = [
            ("session_meta", {"id": thread(i), "cwd": f"/w/p{i % 3}", "source": "exec", "forked_from_id": thread(r.randrange(4))}),
            ("event_msg", {"type": "task_started", "turn_id": turn if r.random() < 0.8 else None, "started_at": at.timestamp() - r.choice([0, 9])}),
            ("turn_context", {"turn_id": turn, "model": r.choice(["gpt-5.5", "gpt-5.6-luna", None]), "effort": r.choice(["low", "high"])}),
            ("event_msg", {"type": "thread_settings_applied", "thread_settings": {"service_tier": r.choice(["priority", ""])}}),
            ("response_item", {"type": "function_call", "name": r.choice("xy"), "call_id": r.choice([None, f"c{r.randrange(30)}"])}),
        ]
        payloads += 3 * [("event_msg", {"type": "token_count", "info": {
            "total_token_usage": usage | {"total_tokens": 1000 * n + r.randrange(1500)}, "last_token_usage": usage, "model_context_window": 1000},
            "rate_limits": {"primary": {"window_minutes": 10080, "used_percent": r.randrange(40), "resets_at": 1_786_000_000 + 604_800 * (n // 20)}}})]
        if r.random() < 0.04:
            return "{broken"
        typ, payload = r.choice(payloads)
        return json.dumps({"timestamp": stamp, "type": typ, "payload": payload})

    def grow(self, i, count, end="\n"):
        own = self.lines.setdefault(i, [])
        new = [self.record(i, len(own) + k) for k in range(count)]
        own += new
        with open(self.path(i), "a") as f:
            f.write("\n".join(new) + end)

    def fork(self, i, j):
        """File j starts with a copy of what file i holds."""
        self.lines[j] = list(self.lines[i])
        with open(self.path(j), "w") as f:
            f.write("\n".join(self.lines[j]) + "\n")


def metadata(spark, titles=(), state=(), edges=()):
    return Metadata(spark.createDataFrame([("default", *t) for t in titles], TITLES_SCHEMA),
                    spark.createDataFrame([{"account_id": "default", **s} for s in state], STATE_SCHEMA),
                    spark.createDataFrame([("default", *e) for e in edges], EDGES_SCHEMA))


def rows(df):
    names = sorted(c for c in df.columns if c not in ("seen", "generated_at", "event_date"))
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())


def same_as_rebuild(spark, log, store, meta):
    roots = [f"{log.root}/sessions"]
    full = ingest(spark, read_rollouts(spark, roots), list_sources(spark, roots), meta, NOW)
    got = read_store(spark, store)
    for name in TABLES:
        assert rows(getattr(got, name)) == rows(getattr(full, name)), name
    return got


def test_a_change_of_everything_equals_a_rebuild(spark, tmp_path):
    log, store = Log(tmp_path, 5), f"{tmp_path}/store"
    roots, none = [f"{log.root}/sessions"], metadata(spark)
    with pytest.raises(LedgerError):
        read_store(spark, store)
    for i in range(5):
        log.grow(i, 60)
    log.fork(2, 7)
    assert refresh_changed(spark, roots, store, none, generated_at=NOW, parts=4)
    assert not refresh_changed(spark, roots, store, none)
    # Tails, of a fork as well, a new file, one that goes, one that is written anew, and one that is as it was.
    log.grow(1, 25)
    log.grow(7, 12)
    log.grow(9, 10)
    os.remove(log.path(3))
    os.remove(log.path(0))
    del log.lines[0]
    log.grow(0, 30)
    # A title, a thread known to the state only, a spawned thread.
    meta = metadata(spark, titles=[(thread(1), "A title")], edges=[(thread(2), thread(9), 1)],
                    state=[{"id": thread(1), "cwd": "/w/own", "tokens_used": 5.0}, {"id": "s", "tokens_used": 77.0, "created_at": 1_786_000_000.0}])
    assert refresh_changed(spark, roots, store, meta, generated_at=NOW)
    got = same_as_rebuild(spark, log, store, meta)
    assert got.threads.filter("title = 'A title'").count() == 1
    count = got.events.count()
    assert Parts.open(spark, store).remove_dead() > 0
    assert read_store(spark, store).events.count() == count > 50


def test_only_touched_parts_are_written(spark, tmp_path):
    log, store = Log(tmp_path, 8), f"{tmp_path}/store"
    roots, none = [f"{log.root}/sessions"], metadata(spark)
    for i in range(12):
        log.grow(i, 80)
    refresh_changed(spark, roots, store, none, generated_at=NOW, parts=24)
    before, count = Parts.open(spark, store), read_store(spark, store).events.count()
    # A line counts when its writer has finished it.
    more = json.dumps({"timestamp": "2026-08-18T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {
        "total_token_usage": {"total_tokens": 1}, "last_token_usage": {"input_tokens": 5, "total_tokens": 5}, "model_context_window": 9}}})
    with open(log.path(4), "a") as f:
        f.write(more[:50])
    assert not refresh_changed(spark, roots, store, none)
    with open(log.path(4), "a") as f:
        f.write(more[50:] + "\n")
    assert refresh_changed(spark, roots, store, none, generated_at=NOW)
    after = Parts.open(spark, store)
    assert read_store(spark, store).events.count() == count + 1
    for table in ("call_copies", "turn_parts", "calls", "origins", "tools", "quota", "events", "threads", "state", "files"):
        moved = {k for k in {*before.live[table], *after.live[table]} if before.live[table].get(k) != after.live[table].get(k)}
        assert len(moved) <= 3 < len(after.live[table]), table
    files = {f for t in after.live for f in after.read(t).inputFiles()}
    kept = {f for t in before.live for f in before.read(t).inputFiles()} & files
    assert len(kept) > 0.8 * len(files)
    # Same size, same time, other content: seen when contents are compared.
    times = os.stat(log.path(4))
    text = open(log.path(4)).read()
    with open(log.path(4), "w") as f:
        f.write(text.replace('"input_tokens": 5, "total_tokens": 5', '"input_tokens": 7, "total_tokens": 7'))
    os.utime(log.path(4), ns=(times.st_atime_ns, times.st_mtime_ns))
    assert not refresh_changed(spark, roots, store, none)
    assert refresh_changed(spark, roots, store, none, generated_at=NOW, compare=True)
    assert read_store(spark, store).events.filter("input_tokens = 7").count() == 1


def test_a_second_writer_fails_and_loses_nothing(spark, tmp_path):
    store = f"{tmp_path}/store"
    ours, theirs = Parts.open(spark, store), Parts.open(spark, store)
    for held, value in ((ours, 1), (theirs, 2)):
        held.replace("t", spark.createDataFrame([(value, "0")], "v int, part_key string"), f"c{value}", {"0"})
    ours.publish("c1", NOW)
    with pytest.raises(PublishConflict):
        theirs.publish("c2", NOW)
    assert [r.v for r in Parts.open(spark, store).read("t").collect()] == [1]


def test_ranges_share_no_line(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    lines = ["", "x" * 30, "é" * 10, "", "last", "z" * 70]
    with open(path, "w", newline="") as f:
        f.write("\r\n".join(lines) + "\nnot finished")
    size = os.path.getsize(path)
    end = whole_lines(path, size)
    assert end == size - len("not finished") and whole_lines(path, 0) == 0
    want = list(lines_between(path, 0, end))
    assert [t for _, t in want] == lines
    for cut in range(end + 1):
        assert [*lines_between(path, 0, cut), *lines_between(path, cut, end)] == want
    ranges = spark.createDataFrame([("a", path, 0, end), ("b", path, 0, 0)], "account_id string, file string, start long, end long")
    got = sorted((r.ord, r.block, r.value) for r in read_ranges(ranges, block_bytes=16).collect())
    assert got == [(at, at // 16, text) for at, text in want]


def test_tails_continue_the_context(spark, tmp_path):
    log = Log(tmp_path, 11)
    for i in range(5):
        log.grow(i, 70)
    scratch = Scratch(spark, "test")
    lines = read_ranges(spark.createDataFrame([("a", log.path(i), 0, os.path.getsize(log.path(i))) for i in range(5)],
                                              "account_id string, file string, start long, end long"))
    records = scratch.store(parse_records(lines), "records")
    whole = C.with_context(records)
    cut = F.pmod(F.xxhash64("file"), F.lit(9_000)) + 2_000
    head, tail = records.filter(F.col("ord") < cut), records.filter(F.col("ord") >= cut)
    state = scratch.store(C.file_state(head), "state")
    parts = C.with_context(head).unionByName(C.with_context(tail, state))
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    assert sorted(map(repr, C.file_state(tail, state).collect())) == sorted(map(repr, C.file_state(records).collect()))
    numbered = C.call_records(C.with_context(head))
    before = numbered.groupBy(*C.CALL_SERIES).agg(F.max("ordinal").alias("ordinal"))
    later = C.call_records(C.with_context(tail, state), before)
    assert sorted(map(repr, numbered.unionByName(later).collect())) == sorted(map(repr, C.call_records(whole).collect()))
    scratch.clear()


def test_stream_of_growing_files(spark, tmp_path):
    log = Log(tmp_path, 3)
    sink, marks = f"{tmp_path}/sink", f"{tmp_path}/marks"

    def run():
        query = (stream_lines(spark, f"{log.root}/sessions", block_bytes=256).writeStream.format("parquet")
                 .option("checkpointLocation", marks).trigger(availableNow=True).start(sink))
        assert query.awaitTermination(180) and query.exception() is None

    def arrived():
        got = spark.read.parquet(sink).select(thread_id_of_file(F.col("file")).alias("t"), "ord", "value").collect()
        out = {}
        for r in sorted(got, key=lambda r: (r.t, r.ord)):
            out.setdefault(r.t, []).append(r.value)
        return out

    log.grow(0, 12)
    log.grow(1, 5)
    run()
    assert arrived() == {thread(i): log.lines[i] for i in (0, 1)}
    # Appended lines, a new file, and a line whose writer is not done; each run starts anew from its checkpoint.
    log.grow(1, 9)
    log.grow(2, 4)
    with open(log.path(0), "a") as f:
        f.write("half")
    run()
    assert arrived() == {thread(i): log.lines[i] for i in (0, 1, 2)}
    with open(log.path(0), "a") as f:
        f.write(" done\n")
    log.lines[0].append("half done")
    run()
    run()
    assert arrived() == {thread(i): log.lines[i] for i in (0, 1, 2)}


def test_small_files_share_stream_tasks(spark, tmp_path):
    os.makedirs(f"{tmp_path}/logs/deep")
    want = {}
    for i in range(200):
        path = f"{tmp_path}/logs/{'deep/' if i % 2 else ''}{i:03d}.jsonl"
        want[path] = [f"{i} {n}" for n in range(i % 7 + 1)]
        with open(path, "w") as f:
            f.write("\n".join(want[path]) + "\n")
    big = f"{tmp_path}/logs/big.jsonl"
    want[big] = [str(n) * 50 for n in range(12_000)]
    with open(big, "w") as f:
        f.write("\n".join(want[big]) + "\n")

    def arrived(rows):
        out = {}
        for file, block, at, text in sorted(rows):
            assert block == at // (1 << 20) and at == sum(len(t) + 1 for _, t in out.get(file, ()))
            out.setdefault(file, []).append((at, text))
        return {file: [t for _, t in texts] for file, texts in out.items()}

    reader = GrowingLinesReader({"path": f"{tmp_path}/logs", "blockBytes": str(1 << 20), "tasks": "2"})
    parts = reader.partitions({}, end := reader.latestOffset())
    blocks = -(-os.path.getsize(big) // (1 << 20))
    # Some 15 small files share a task; of a large file, a task has a block.
    assert blocks > 2 and len(parts) < blocks + 20
    assert max(sum(r[2] - r[1] for r in p.ranges) for p in parts) <= 1 << 20
    rows = []
    for p in parts:
        rows += reader.read(p)
    small = [r for r in rows if r[0] != big]
    assert arrived(small) == {f: t for f, t in want.items() if f != big}
    assert [t for *_, t in sorted(r for r in rows if r[0] == big)] == want[big]
    # What is left when most was read before; nothing at all still is one partition.
    assert [r for p in reader.partitions(end | {big: end[big] - 1}, end) for r in p.ranges] == [(big, end[big] - 1, end[big])]
    assert [p.ranges for p in reader.partitions(end, end)] == [[]]
    # As many tasks as there are cores get something, if there are as many files.
    wide = GrowingLinesReader({"path": f"{tmp_path}/logs/deep", "tasks": "8"})
    assert 8 <= len(wide.partitions({}, wide.latestOffset())) <= 10

    query = (stream_lines(spark, f"{tmp_path}/logs").writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(f"{tmp_path}/sink"))
    assert query.awaitTermination(180) and query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/sink")
    assert len(got.inputFiles()) < 30
    lines = {}
    for r in sorted(got.collect(), key=lambda r: (r.file, r.ord)):
        lines.setdefault(r.file, []).append(r.value)
    assert lines == want


def test_logs_are_written_in_two_parts(spark, tmp_path):
    lines = [(f"/logs/{f}.jsonl", n // 2, f"{f} {n * 7 % 5} {'é' * n}") for f in range(40) for n in range(f % 9 + 1)]
    table = spark.createDataFrame(lines, "file string, ord long, value string")
    folder = f"{tmp_path}/sessions"
    size = sum(write_logs(table.orderBy(F.rand(n)), f"file://{folder}", *part) for n, part in enumerate([(0.0, 0.55), (0.55, 1.0)]))
    want = {}
    for file, at, text in sorted(lines):
        want.setdefault(file.rsplit("/", 1)[-1], []).append(text)
    assert {n: open(f"{folder}/{n}").read().split("\n") for n in os.listdir(folder)} == {n: [*t, ""] for n, t in want.items()}
    assert size == sum(os.path.getsize(f"{folder}/{n}") for n in want)
