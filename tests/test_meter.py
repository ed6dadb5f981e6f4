import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.operators import burn as burning
from meterlake.operators import dedupe, meter
from meterlake.operators.windows import in_range, multi_day_window
from meterlake.plans.report import usage_trend

OBS = (
    "account_id string, ts timestamp, used_percent double, window_minutes int, resets_at long, "
    "limit_key string, limit_name string, scope string, event_cutoff_at timestamp, seen long"
)
EV = (
    "account_id string, id string, ts timestamp, thread_id string, project string, model string, "
    "effort string, service_tier string, input_tokens long, cached_input_tokens long, "
    "output_tokens long, total_tokens long, rate_card_credits double, seen long"
)


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def epoch(text):
    return int(at(text).timestamp())


def readings(spark, rows, account="a"):
    return spark.createDataFrame([
        (account, at(t) if isinstance(t, str) else t, float(u), 10_080,
         epoch(r) if isinstance(r, str) else r, None, None, None, None, i)
        for i, (t, u, r) in enumerate(rows)], OBS)


def event(i, t, model, inp, tier=None):
    return ("a", f"e{i}", at(t), "t", "p", model, "high", tier, inp, 0, 0, inp, None, i)


R1 = "2026-08-10T00:00"
R2 = "2026-08-12T00:00"


def test_timelines(spark):
    cases = {
        "restart": ([("2026-08-04T00:00", 50, R1), ("2026-08-04T12:00", 90, R1),
                     ("2026-08-05T00:00", 0, R2), ("2026-08-05T12:00", 30, R2)],
                    [(50, 0, "start"), (90, 0, "start"), (0, 1, "restart"), (30, 1, "restart")]),
        "stale": ([("2026-08-04T00:00", 50, R1), ("2026-08-05T00:00", 5, R2),
                   ("2026-08-05T06:00", 95, R1), ("2026-08-05T12:00", 20, R2)],
                  [(50, 0, "start"), (5, 1, "restart"), (20, 1, "restart")]),
        "transient": ([("2026-08-04T00:00", 20, R1), ("2026-08-04T06:00", 0, "2026-08-14T00:00"),
                       ("2026-08-04T12:00", 40, R1), ("2026-08-05T00:00", 60, R1)],
                      [(20, 0, "start"), (40, 0, "start"), (60, 0, "start")]),
        "monotone": ([("2026-08-09T12:00", 20, "2026-08-11T10:00"),
                      ("2026-08-10T12:00", 30, "2026-08-11T10:00"),
                      ("2026-08-11T09:00", 24, "2026-08-11T10:00"),
                      ("2026-08-12T12:00", 5, "2026-08-18T10:00")],
                     [(20, 0, "start"), (30, 0, "start"), (30, 0, "start"),
                      (5, 1, "weekly-expiry")]),
    }
    every = None
    for name, (rows, _) in cases.items():
        df = readings(spark, rows, name)
        every = df if every is None else every.unionByName(df)
    got = meter.timeline(every).orderBy("account_id", "ts").collect()
    for name, (_, want) in cases.items():
        rows = [(r["normalized_used_percent"], r["cycle"], r["reset_kind"]) for r in got
                if r["account_id"] == name]
        assert rows == want, name


def test_named_limits_are_other_meters(spark):
    rows = [("a", at(f"2026-08-04T0{i}:00"), u, 10_080, epoch(R1), k, n, None, None, i)
            for i, (u, k, n) in enumerate([(10.0, "aaa", None), (50.0, "bbb", "Named"),
                                           (20.0, "aaa", None)])]
    got = meter.select_meter(meter.weekly_observations(spark.createDataFrame(rows, OBS))).collect()
    assert sorted(r["used_percent"] for r in got) == [10, 20]


def sequential_windows(rows):
    opened, out = [], []
    for _, _, reset in rows:
        for i, latest in enumerate(opened):
            if abs(latest - reset) <= 300:
                opened[i] = max(latest, reset)
                break
        else:
            i = len(opened)
            opened.append(reset)
        out.append(i)
    return out


def test_windows_match_the_sequential_rule_on_chained_jitter(spark):
    rng = random.Random(7)
    frames, want = None, {}
    for case in range(12):
        base = 1_786_000_000
        rows = [(at("2026-08-01T00:00") + timedelta(hours=5 * i), 1.0,
                 base + rng.choice([0, 120, 250, 290, 400, 520, 700, 5_000])) for i in range(30)]
        rows.sort(key=lambda r: (r[0], r[2]))
        want[f"c{case:02}"] = sequential_windows(rows)
        df = readings(spark, rows, f"c{case:02}")
        frames = df if frames is None else frames.unionByName(df)
    got = meter.assign_epochs(frames).orderBy("account_id", "seen").collect()
    for name, labels in want.items():
        mine = [(r["cluster"], r["part"]) for r in got if r["account_id"] == name]
        pairs = set(zip(mine, labels, strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_burn_splits_by_credits_and_days(spark):
    b = multi_day_window("2026-08-15", "UTC", 7)
    quota = readings(spark, [("2026-08-12T06:00", 0, "2026-08-19T00:00"),
                             ("2026-08-12T18:00", 20, "2026-08-19T00:00"),
                             ("2026-08-15T00:00", 40, "2026-08-19T00:00")])
    events = spark.createDataFrame([
        event(0, "2026-08-12T10:00", "gpt-5.6-luna", 2_500_000),
        event(1, "2026-08-12T11:00", "gpt-5.6-sol", 100_000)], EV)
    t = usage_trend(events, quota, b)
    bins = {(str(r["start_day"]), r["model"]): (r["points"], r["approximate"])
            for r in burning.burn_bins(t.spans, b).collect()}
    assert bins[("2026-08-12", "Luna")] == (pytest.approx(10), True)
    assert bins[("2026-08-12", "Sol")] == (pytest.approx(10), True)
    assert bins[("2026-08-12", "Unattributed")][0] == pytest.approx(20 * 6 / 54)
    assert bins[("2026-08-13", "Unattributed")] == (pytest.approx(20 * 24 / 54), True)
    assert bins[("2026-08-14", "Unattributed")][0] == pytest.approx(20 * 24 / 54)
    assert sum(v for v, _ in bins.values()) == pytest.approx(40)


def test_priority_weighs_half_as_much_again(spark):
    b = multi_day_window("2026-08-15", "UTC", 7)
    quota = readings(spark, [("2026-08-12T06:00", 0, "2026-08-19T00:00"),
                             ("2026-08-12T18:00", 25, "2026-08-19T00:00")])
    events = spark.createDataFrame([
        event(0, "2026-08-12T10:00", "gpt-5.6-sol", 1_000_000, "priority"),
        event(1, "2026-08-12T11:00", "gpt-5.5", 1_000_000)], EV)
    spans = burning.burn(meter.timeline(quota), events, b)
    got = {r["model"]: r["model_points"] for r in burning.burn_by_model(spans).collect()}
    assert got == {"Sol": pytest.approx(15), "GPT-5.5": pytest.approx(10)}


def test_cycles_before_the_window_are_not_read(spark, tmp_path):
    b = multi_day_window("2026-08-15", "UTC", 3)
    quota = readings(spark, [("2026-07-30T06:00", 0, "2026-08-05T00:00"),
                             ("2026-07-31T18:00", 40, "2026-08-05T00:00"),
                             ("2026-08-12T06:00", 5, "2026-08-19T00:00"),
                             ("2026-08-14T18:00", 25, "2026-08-19T00:00")])
    days = ["2026-07-31T10:00", "2026-08-12T05:00", "2026-08-13T10:00", "2026-08-14T10:00"]
    rows = [event(i, t, "gpt-5.6-sol" if i % 2 else "gpt-5.5", 1_000_000) for i, t in enumerate(days)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, EV).withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(path)
    events = spark.read.parquet(path)
    tl = meter.timeline(quota)
    some, every = burning.burn(tl, events, b, shown_only=True), burning.burn(tl, events, b)
    assert {r["cycle"] for r in every.collect()} > {r["cycle"] for r in some.collect()}
    pairs = [burning.clip, burning.burn_bins, burning.allocation_method]
    for f in pairs:
        assert f(some, b).exceptAll(f(every, b)).isEmpty() and f(every, b).exceptAll(f(some, b)).isEmpty()
    low = spark.createDataFrame([(at("2026-08-12T00:00"),)], "t timestamp").agg(F.min("t")).scalar()
    plan = in_range(events, low, F.lit(b.end))._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert ">=" in scan and "subquery" in scan


def test_equal_meters_are_settled_by_time_not_by_file(spark):
    rows = [("a", key, 10080, epoch("2026-08-19T00:00"), used, at(t), None, key, True, file, 0, i, 0)
            for i, (key, used, t, file) in enumerate([
                ("late", 1.0, "2026-08-13T00:00", "archived/x.jsonl"), ("late", 2.0, "2026-08-13T01:00", "archived/x.jsonl"),
                ("early", 1.0, "2026-08-12T00:00", "sessions/y.jsonl"), ("early", 2.0, "2026-08-12T01:00", "sessions/y.jsonl")])]
    quota = dedupe.dedupe_quota(spark.createDataFrame(rows, (
        "account_id string, limit_key string, window_minutes int, resets_at long, used_percent double, ts timestamp, "
        "plan_type string, limit_name string, original_likely boolean, file string, block long, ord long, part int")))
    got = meter.select_meter(meter.weekly_observations(quota))
    assert {r["limit_key"] for r in got.collect()} == {"early"}


def test_a_busy_hour_is_spread_and_paired_like_the_sequential_rule(spark):
    rng = random.Random(5)
    began = at("2026-08-10T00:00:00")
    marks = sorted(rng.sample(range(0, 3_600_000, 1000), 40))
    spans = [(began + timedelta(milliseconds=lo), began + timedelta(milliseconds=hi))
             for lo, hi in zip(marks[::2], marks[1::2])]
    intervals = spark.createDataFrame(
        [("a", 0, 1.0 * i, lo, hi, 1.0) for i, (lo, hi) in enumerate(spans)],
        "account_id string, cycle long, used_percent double, start_ts timestamp, "
        "end_ts timestamp, points double")
    times = [began + timedelta(milliseconds=rng.randrange(3_600_000)) for _ in range(4000)]
    times += [t for pair in spans for t in pair]
    events = spark.createDataFrame(
        [("a", t, i) for i, t in enumerate(times)], "account_id string, ts timestamp, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in burning.place_events(intervals, events)
                 .groupBy("_chunk").count().collect()]
        got = {r["n"]: r["u"] for r in burning.assign_events(intervals, events)
               .filter("not is_span").selectExpr("n", "iv.used_percent as u").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * len(times) / len(sizes)
    want = {i: float(k) for i, t in enumerate(times) for k, (lo, hi) in enumerate(spans)
            if lo < t <= hi}
    assert got == want
