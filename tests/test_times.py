"""Queries whose results hang on parts of a second and on halves, on events written for it, against their SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest

from evidra.plans.catalog import QUERIES, SQL
from tests.conftest import rows_of

NOW = datetime(2024, 1, 30, 23, 59, 25, 200_000)


@pytest.fixture(scope="module")
def compared(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("times")
    # seconds before NOW, type, value: 600.3 s are 600 whole seconds though 601 seconds change; 62.5 / 25 is half way between 2 and 3
    ages = [(0.0, "error", 1.0), (600.3, "error", 1.0), (601.0, "error", 1.0), (1000.0, "error", 62.5), (1000.0, "error", 87.5), (7200.9, "error", 90.0), (7201.2, "error", 90.0), (2592000.4, "view", 1.0), (2592001.3, "view", 1.0)]
    rows = [(i, NOW - timedelta(seconds=s), i, kind, value, "{}") for i, (s, kind, value) in enumerate(ages)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.range(len(ages) + 2).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{folder}/customer.parquet")

    def check(name):
        con = duckdb.connect()
        for t in ("events", "customer"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
        found, wanted = QUERIES[name](spark, str(folder)).toPandas(), con.sql(SQL[name]).df()
        assert rows_of(found, sorted(found.columns)) == rows_of(wanted, sorted(wanted.columns))
        return found

    return check


def test_cleanup_counts_whole_seconds_and_halves_to_even(compared):
    assert sorted(compared("cache_cleanup")["event_id"]) == [0, 1, 4, 5, 7]


def test_states_count_whole_seconds_and_halves_to_even(compared):
    found = compared("cache_states").set_index("user_id")["state"]
    assert found[1] == "cache_hit_failure_short" and found[3] == "cache_expired_retry"


def test_work_leaves_out_what_is_still_good(compared):
    assert sorted(compared("cache_work")["user_id"]) == [2, 3, 6, 8, 9, 10]


@pytest.mark.parametrize("odd", ["null user that is good", "null user that is expired", "null time", "null customer", "no events"])
def test_work_and_states_with_nulls(spark, tmp_path, odd):
    """NOT IN a set with a null holds for nothing; a null time is the latest one and neither good nor expired."""
    rows = [(0, NOW, 0, "error", 1.0, "{}"), (1, NOW - timedelta(seconds=700), 1, "error", 1.0, "{}"), (2, NOW - timedelta(days=31), 2, "view", 1.0, "{}"), (3, NOW, 3, "view", None, "{}"), (4, NOW, 3, "view", 80.0, "{}"), (5, NOW, 4, "error", 80.0, "{}"), (6, NOW, 4, None, 80.0, "{}")]
    more = {"null user that is good": [(NOW, None)], "null user that is expired": [(NOW - timedelta(days=31), None)], "null time": [(None, 1), (None, 5), (None, 2)]}
    rows = [] if odd == "no events" else rows + [(10 + i, t, u, "view", 1.0, "{}") for i, (t, u) in enumerate(more.get(odd, []))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    keys = [(i,) for i in range(8)] + [(None,)] * (odd in ("null customer", "no events"))
    spark.createDataFrame(keys, "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("cache_work", "cache_states"):
        found, wanted = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
        assert rows_of(found, sorted(found.columns)) == rows_of(wanted, sorted(wanted.columns)), name


def test_durations_are_of_rounded_milliseconds(spark, tmp_path):
    base = datetime(2024, 1, 1)
    # milliseconds of the ends: .6 and .2 (1 and 10), .4 and .4, .5 and .5, .2 and .6
    ends = [(600, 10_200), (400, 10_400), (500, 10_500), (200, 10_600)]
    rows = [(2 * i + j, base + timedelta(microseconds=us), i, "purchase", 1.0, "{}") for i, pair in enumerate(ends) for j, us in enumerate(pair)]
    # the last sign of runs that aren't ended, a day and 0.4 ms before the latest time, and a day and 0.6 ms
    rows += [(100 + k, base + timedelta(microseconds=us) - timedelta(days=1), 10 + k, "view", 1.0, "{}") for k, us in enumerate((10_200, 10_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("run_durations", "watchdog"):
        found, wanted = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
        assert rows_of(found, sorted(found.columns)) == rows_of(wanted, sorted(wanted.columns))
        if name == "run_durations":
            assert dict(zip(found["user_id"], found["duration_ms"])) == {0: 9, 1: 10, 2: 10, 3: 11, 10: 0, 11: 0}
