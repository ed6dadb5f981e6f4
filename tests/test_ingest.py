import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.operators.dedupe import thread_parents
from meterlake.plans.ingest import Metadata, context_records, ingest
from meterlake.sources.ledger import (
    LedgerError,
    read_ledger,
    read_snapshot_json,
    write_ledger,
)
from meterlake.sources.metadata import TITLES_SCHEMA, read_titles, thread_state
from meterlake.sources.rollouts import list_sources, read_rollouts, session_roots
from meterlake.streaming.refresh import clean_up, refresh

A = "11111111-1111-4111-8111-111111111111"
B = "22222222-2222-4222-8222-222222222222"
NOW = datetime(2026, 8, 20, tzinfo=UTC)


def line(at, typ, **payload):
    return json.dumps({"timestamp": at, "type": typ, "payload": payload})


def usage(i, c, o, r=0):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o,
            "reasoning_output_tokens": r, "total_tokens": i + o}


def tokens(at, n, last, **more):
    return line(at, "event_msg", type="token_count", info={
        "total_token_usage": usage(n, 0, 0), "last_token_usage": last,
        "model_context_window": 1000}, **more)


def settings(at, tier):
    return line(at, "event_msg", type="thread_settings_applied",
                thread_settings={"model": "gpt-5.6-sol", "service_tier": tier})


def original():
    d = "2026-08-10T00:00:0"
    start = int(datetime(2026, 8, 10, tzinfo=UTC).timestamp())
    return [
        line(d + "0Z", "session_meta", id=A, cwd="/w/alpha", source="exec", forked_from_id=B),
        line(d + "0Z", "event_msg", type="task_started", turn_id="t1", started_at=start),
        line(d + "0Z", "turn_context", turn_id="t1", model="gpt-5.6-sol", effort="high"),
        settings(d + "1Z", "priority"),
        tokens(d + "2Z", 100, usage(1000, 0, 100), rate_limits={"primary": {
            "window_minutes": 10080, "used_percent": 12.5, "resets_at": start + 86400}}),
        "", "{broken",
        line(d + "3Z", "response_item", type="function_call", name="x", call_id="c1"),
        settings(d + "4Z", ""),
        tokens(d + "5Z", 90, usage(1000, 0, 100)),
        line(d + "6Z", "turn_context", turn_id="t2", model="gpt-5.4 mini"),
        tokens(d + "7Z", 200, usage(90, 500, 10, 40)),
    ]


def write(root, name, lines):
    path = os.path.join(root, "sessions", "2026")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def empty_meta(spark):
    state, edges = thread_state(spark)
    return Metadata(spark.createDataFrame([], TITLES_SCHEMA), state, edges)


@pytest.fixture()
def home(tmp_path):
    write(tmp_path, f"rollout-{A}.jsonl", original())
    # A fork an hour later, in a file that sorts first, holding a copy of the first call.
    late = [x.replace("2026-08-10T00", "2026-08-10T01") for x in original()[1:5]]
    write(tmp_path, f"a-{B}.jsonl", late)
    return str(tmp_path)


def test_log_tree_to_ledger_and_back(spark, home, tmp_path):
    roots = session_roots(home)
    lines = read_rollouts(spark, roots)
    led = ingest(spark, lines, list_sources(spark, roots), empty_meta(spark), NOW)
    store = str(tmp_path / "store")
    write_ledger(led, store, NOW)
    back = read_ledger(spark, store)
    ev = back.events.orderBy("ts").collect()
    assert len(ev) == 3
    assert [e["service_tier"] for e in ev] == ["priority", None, None]
    assert ev[0]["rate_card_credits"] / ev[1]["rate_card_credits"] == pytest.approx(1.5)
    assert {e["thread_id"] for e in ev} == {A}
    assert {e["project"] for e in ev} == {"alpha"}
    assert [e["tool_calls"] for e in ev] == [0, 1, 0]
    mini = ev[2]
    assert (mini["model"], mini["cached_input_tokens"], mini["reasoning_tokens"]) == (
        "gpt-5.4-mini", 90, 10)
    assert mini["rate_card_credits"] == pytest.approx(0.00129875)
    cov = back.coverage.first()
    assert (cov["files_scanned"], cov["parse_errors"], cov["duplicate_events_skipped"],
            cov["correction_intervals"]) == (2, 1, 1, 1)
    threads = {t["id"]: t for t in back.threads.collect()}
    assert threads[A]["parent_thread_id"] == B
    assert (threads[A]["source"], threads[A]["coverage"]) == ("cli", "complete")
    assert back.quota_observations.count() == 1
    with pytest.raises(LedgerError):
        read_ledger(spark, str(tmp_path / "nothing"))


def test_state_only_threads_and_titles(spark, home, tmp_path):
    state = spark.createDataFrame(
        [("default", "s1", 1_786_000_000.0, "/w/beta", 77.0, "subagent")],
        "account_id string, id string, created_at double, cwd string, tokens_used double, "
        "thread_source string")
    index = tmp_path / "session_index.jsonl"
    index.write_text("\n".join([
        json.dumps({"id": A, "thread_name": "old", "updated_at": "2026-08-01T00:00:00Z"}),
        json.dumps({"id": A, "thread_name": "new  name", "updated_at": "2026-08-02T00:00:00Z"}),
        "{oops"]))
    rows, edges = thread_state(spark, state)
    roots = session_roots(home)
    led = ingest(spark, read_rollouts(spark, roots), list_sources(spark, roots),
                 Metadata(read_titles(spark, str(index)), rows, edges), NOW)
    threads = {t["id"]: t for t in led.threads.collect()}
    assert threads[A]["title"] == "new name"
    assert (threads["s1"]["coverage"], threads["s1"]["project"], threads["s1"]["use_type"]) == (
        "unresolved", "beta", "subagent")
    assert threads["s1"]["reported_cumulative_tokens"] == 77


def test_refresh_equals_full_rebuild(spark, home, tmp_path):
    roots, store = session_roots(home), str(tmp_path / "store")
    meta = empty_meta(spark)
    assert refresh(spark, roots, store, meta)
    assert not refresh(spark, roots, store, meta)
    write(home, f"rollout-{A}.jsonl",
          [*original(), tokens("2026-08-10T00:00:09Z", 300, usage(5, 0, 5))])
    os.remove(os.path.join(home, "sessions", "2026", f"a-{B}.jsonl"))
    assert refresh(spark, roots, store, meta)
    full = ingest(spark, read_rollouts(spark, roots), list_sources(spark, roots), meta, NOW)
    cols = [F.col(c) for c in full.events.columns if c != "seen"]
    got = read_ledger(spark, f"{store}/ledger").events.select(*cols)
    want = full.events.select(*cols)
    assert got.count() == 4
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_json_snapshot(spark, tmp_path):
    doc = {"generatedAt": "2026-08-19T23:45:00.000Z", "events": [
        {"id": "e", "timestamp": "2026-08-19T12:00:00.000Z", "threadId": "t", "project": "Alpha",
         "model": "gpt-5.5", "totalTokens": 1200, "inputTokens": 1000, "outputTokens": 200}],
        "threads": [{"id": "t", "project": "Alpha"}]}
    path = tmp_path / "snap.json"
    path.write_text(json.dumps(doc, indent=1))
    led = read_snapshot_json(spark, str(path))
    assert led.events.first()["total_tokens"] == 1200
    assert led.quota_observations.count() == 0
    path2 = tmp_path / "bad.json"
    path2.write_text("{}")
    with pytest.raises(LedgerError):
        read_snapshot_json(spark, str(path2))


def test_stream_trigger_and_refresh_decision(spark, home, tmp_path):
    from datetime import timedelta

    from meterlake.sources.freshness import ledger_freshness, needs_refresh
    from meterlake.streaming.refresh import refresh_stream

    store, seen = str(tmp_path / "store"), []
    query = refresh_stream(spark, f"{home}/sessions", store, empty_meta(spark),
                           on_done=seen.append)
    assert query.awaitTermination(120)
    assert seen == [True]
    led = read_ledger(spark, f"{store}/ledger")
    made = led.provenance.first()["generated_at"].replace(tzinfo=UTC)
    roots = session_roots(home)
    young, old = made + timedelta(minutes=15), made + timedelta(hours=2)
    assert not needs_refresh(spark, f"{store}/ledger", roots, young)
    assert not needs_refresh(spark, f"{store}/ledger", roots, old)
    assert needs_refresh(spark, str(tmp_path / "none"), roots, old)
    r = ledger_freshness(led.provenance, young).first()
    assert (r["status"], r["age_label"]) == ("fresh", "15m old")
    assert ledger_freshness(led.provenance, old).first()["age_label"] == "2h old"


def test_long_files_are_cut_and_lines_parsed_once(spark, home):
    more = [x.replace("2026-08-10T00", f"2026-08-1{d}T02") for d in range(1, 9) for x in original()[2:]]
    write(home, f"rollout-{A}.jsonl", [*original(), *more])
    columns = ["file", "kind", "model", "effort", "service_tier", "turn", "start.turn_id",
               "counter_before", "ts", "original_likely"]

    def records():
        return context_records(read_rollouts(spark, session_roots(home))).select(*columns)

    whole = records()
    assert "Scan text" not in whole._jdf.queryExecution().toString()
    whole = whole.collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert read_rollouts(spark, session_roots(home)).filter("split").select(
            "file", "block").distinct().count() > 5
        parts = records().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(repr, parts)) == sorted(map(repr, whole))


def test_the_last_spawn_edge_counts(spark):
    _, edges = thread_state(spark, spark.range(0).selectExpr("cast(id as string) id"), spark.createDataFrame(
        [("p2", "c", 2), ("p9", "c", 1), ("p1", "d", None), ("p3", "d", None), ("p4", "e", 7)],
        "parent_thread_id string, child_thread_id string, position long"))
    metas = spark.createDataFrame(
        [("default", "e", "m", "f", 0, 3)],
        "account_id string, thread_id string, parent_thread_id string, file string, block long, ord long")
    for rows in edges, edges.orderBy(F.desc("parent_thread_id")), edges.repartition(5):
        got = {r["thread_id"]: r["parent_thread_id"] for r in thread_parents(rows, metas).collect()}
        assert got == {"c": "p2", "d": "p3", "e": "m"}


def test_clean_up_keeps_what_is_current(spark, home, tmp_path):
    roots, store = session_roots(home), str(tmp_path / "store")
    meta = empty_meta(spark)
    refresh(spark, roots, store, meta)
    for n in (1, 2):
        write(home, f"rollout-{A}.jsonl",
              [*original(), *[tokens(f"2026-08-10T00:00:{10 + i}Z", 300 + i, usage(5, 0, 5)) for i in range(n)]])
        assert refresh(spark, roots, store, meta)
    before = read_ledger(spark, f"{store}/ledger").events.count()
    # Two old ledgers, two old manifests and the batch in between; the first batch still has a file.
    assert clean_up(spark, store) == 5
    assert clean_up(spark, store) == 0
    assert read_ledger(spark, f"{store}/ledger").events.count() == before == 5
    write(home, f"rollout-{A}.jsonl", original())
    assert refresh(spark, roots, store, meta)
    assert read_ledger(spark, f"{store}/ledger").events.count() == 3
