"""Sinks with commit records, and streams with keyed state that land in them."""
from datetime import datetime, timedelta

import pytest
from conftest import rows

from rillmap.sources import commits as CO
from rillmap.streaming import ingest as IN

START = datetime(2024, 1, 1)


def test_a_repeated_or_killed_append_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows(CO.commits(spark, path)) == []
    with pytest.raises(ValueError, match="no committed run"):
        CO.read_committed(spark, path)
    assert CO.append_run(spark.range(5), path, "a") and not CO.append_run(spark.range(5), path, "a")
    spark.range(100, 200).write.parquet(f"{path}/rows/run=b")                   # killed after its rows
    assert sorted(r[0] for r in CO.read_committed(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert CO.append_run(spark.range(5, 7), path, "b")                          # the repeat replaces the rows of the first attempt
    assert sorted(r[0] for r in CO.read_committed(spark, path).collect()) == list(range(7))
    assert rows(CO.commits(spark, path).select("run", "n_rows"), "run") == [("a", 5), ("b", 2)]
    with pytest.raises(ValueError, match="run name"):
        CO.append_run(spark.range(1), path, "x/y")


def test_compaction_takes_the_place_of_runs_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        CO.append_run(spark.range(k * 10, k * 10 + 10), path, f"r{k}")
    CO.append_run(spark.range(0), path, "empty")
    CO.read_committed(spark, path).limit(3).write.parquet(f"{path}/rows/run=all")           # a compaction that was killed
    assert CO.compact(spark, path, "all") and not CO.compact(spark, path, "again")
    assert rows(CO.commits(spark, path).select("run", "n_rows")) == [("all", 30)]
    assert not CO.append_run(spark.range(9), path, "r1")                                    # a replaced run is still done
    assert CO.clean(spark, path) == 4 and sorted(r[0] for r in CO.read_committed(spark, path).collect()) == list(range(30))


def test_later_columns_are_null_in_earlier_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    CO.append_run(spark.createDataFrame([(1,)], "id int"), path, "a")
    CO.append_run(spark.createDataFrame([(2, "x")], "id int, run_by string"), path, "b")
    assert rows(CO.read_committed(spark, path), "id") == [(1, None), (2, "x")]


def land(spark, base, *seen):
    data = spark.createDataFrame([(k, START + timedelta(hours=h), v) for k, h, v in seen], "id int, at timestamp, v string")
    data.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return IN.ingest_within(spark, f"{base}/in", data.schema, f"{base}/out", f"{base}/ck", "id", "at", "2 hours", most_runs=3)


def test_a_late_repeat_inside_the_watermark_is_dropped_and_state_is_bounded(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, (1, 0.0, "first"), (2, 0.5, "first"), (None, 0.5, "no key"))
    land(spark, base, (1, 1.0, "late repeat"), (3, 1.0, "first"))
    assert sorted(r["v"] for r in CO.read_committed(spark, f"{base}/out").collect()) == ["first"] * 3 + ["no key"]
    held = []
    for day in range(1, 6):                                                     # a hundred new keys a day
        progress = land(spark, base, *[(1000 * day + k, 24.0 * day, "day") for k in range(100)])
        held.append(max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]))
    out = CO.read_committed(spark, f"{base}/out")
    assert out.count() == 504 and out.where("v = 'late repeat'").isEmpty()
    assert held[-1] == held[1] <= 200                                           # not the 504 keys of the whole stream
    assert CO.commits(spark, f"{base}/out").count() <= 4                        # compacted on the way


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, (1, 0.0, "a"), (2, 0.1, "b"))
    done = CO.commits(spark, f"{base}/out").select("run").first()[0]
    assert not CO.append_run(spark.createDataFrame([(1, START, "a")], "id int, at timestamp, v string"), f"{base}/out", done)
    assert rows(CO.read_committed(spark, f"{base}/out").select("id", "v"), "id") == [(1, "a"), (2, "b")]


def test_a_row_without_time_stops_the_stream(spark, tmp_path):
    data = spark.createDataFrame([(1, None)], "id int, at timestamp")
    data.write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="at is NULL"):
        IN.ingest_within(spark, f"{tmp_path}/in", data.schema, f"{tmp_path}/out", f"{tmp_path}/ck", "id", "at", "1 hour")
