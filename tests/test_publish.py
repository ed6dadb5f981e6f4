"""Numbered pointers: of two writers one wins, and no clock decides."""

from datetime import UTC, datetime

import pytest

from meterlake.sources.ledger import LedgerError, PublishConflict, current_version, newest_pointer, publish
from meterlake.storage import create_small, file_names, read_small

NOW = datetime(2026, 8, 20, 3, 4, 5, tzinfo=UTC)


def test_a_name_is_taken_once(spark, tmp_path):
    path = f"{tmp_path}/a/pointer"
    assert create_small(spark, path, "one")
    assert not create_small(spark, path, "two")
    assert read_small(spark, path) == "one"
    assert file_names(spark, f"{tmp_path}/a") == ["pointer"]
    assert file_names(spark, f"{tmp_path}/none") == []


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(LedgerError):
        current_version(spark, path)
    assert publish(spark, path, "v1", NOW) == 1
    first, second = newest_pointer(spark, path)[0], newest_pointer(spark, path)[0]
    assert publish(spark, path, "v2", NOW, after=first) == 2
    with pytest.raises(PublishConflict):
        publish(spark, path, "v3", NOW, after=second)
    assert current_version(spark, path)[0] == "v2"


def test_a_clock_set_back_loses_nothing(spark, tmp_path):
    path = str(tmp_path)
    publish(spark, path, "late", datetime(2030, 1, 1, tzinfo=UTC))
    # A writer that does not care what it replaces takes the number behind.
    assert publish(spark, path, "early", NOW) == 2
    assert current_version(spark, path)[0] == "early"
    for i in range(12):
        publish(spark, path, f"n{i}", NOW)
    assert current_version(spark, path)[0] == "n11"
