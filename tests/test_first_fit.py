"""Drifting reset times: step functions and windows against the sequential rule."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.operators.first_fit import Steps, first_fit, first_fit_windows
from meterlake.operators.meter import assign_epochs
from meterlake.storage import Scratch


def test_steps_equal_reading_by_reading():
    r = random.Random(1)
    for _ in range(1500):
        span, jitter = r.choice([20, 60, 200]), r.choice([3, 10, 30])
        values = [r.randrange(span) for _ in range(r.randint(1, 60))]
        steps = Steps()
        for v in values:
            steps.then(v, jitter)
        assert steps.target == sorted(steps.target) and all(a < b for a, b in zip(steps.low, steps.high))
        for v in range(-5, span + 5):
            w = v
            for x in values:
                if x - jitter <= w < x:
                    w = x
            assert steps(v) == w


@pytest.mark.parametrize("chunk_rows", [7, 40, 1000])
def test_windows_of_chunks_equal_the_sequential_rule(spark, chunk_rows):
    r = random.Random(chunk_rows)
    groups = {"steady": [5] * 30, "climbing": [i * 9 + r.randrange(5) for i in range(90)], "one": [3],
              "mixed": [r.choice([0, 40, 80]) + r.randrange(30) for _ in range(150)]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, i int, v long").repartition(5)
    scratch = Scratch(spark, "test")
    got = {(x.g, x.i): x.part for x in first_fit_windows(table, ["g"], "v", ["i"], 10, scratch, chunk_rows).collect()}
    assert got == {(g, i): w for g, values in groups.items() for i, w in enumerate(first_fit(values, 10))}
    scratch.clear()


def test_one_chained_account_spreads_over_tasks(spark):
    r = random.Random(4)
    at = datetime(2026, 8, 1, tzinfo=UTC)
    rows = [("a", at + timedelta(minutes=i), 1_786_000_000 + i * 2 + r.randrange(900), i) for i in range(1200)]
    obs = spark.createDataFrame(rows, "account_id string, ts timestamp, resets_at long, seen int")
    placed = assign_epochs(obs, chunk_rows=100)
    got = {x.seen: x.part for x in placed.collect()}
    assert placed.select("cluster").distinct().count() == 1
    want = first_fit([x[2] for x in rows], 300)
    assert [got[i] for i in range(1200)] == want and max(want) > 2
    folder = {f.rsplit("/", 1)[0] for f in placed.inputFiles() if "/told-" in f}
    chunks = spark.read.parquet(min(folder)).groupBy("_chunk").count()
    assert chunks.count() >= 8 and chunks.agg(F.max("count")).first()[0] < 300
