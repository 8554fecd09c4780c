import datetime as dt

import pytest
from pyspark.sql import functions as F

from perfloom.operators import history
from perfloom.streaming import observe

EVENT = "event_id long, ts timestamp, user string, event_type string, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def event(i, minutes, user="u", kind="view", value=1.0):
    return (i, at(minutes), user, kind, value)


def feed(spark, folder, n, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder, schema=EVENT):
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def test_windows_close_once_and_too_late_events_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    closed = lambda: sorted((r.window.start, r.event_type, r.n) for r in spark.read.parquet(out).collect())
    feed(spark, folder, 1, [event(1, 5), event(2, 50), event(3, 70)])
    windows = observe.windowed(stream(spark, folder), window="1 hour", late="30 minutes")
    observe.collect_closed(windows, out)
    assert closed() == []  # the watermark is at minute 40
    feed(spark, folder, 2, [event(4, 45), event(5, 200, kind="error")])  # late, but in time
    observe.collect_closed(windows, out)
    assert closed() == [(at(0), "view", 3), (at(60), "view", 1)]
    feed(spark, folder, 3, [event(6, 20), event(7, 100), event(8, 180, kind="error"), event(9, 400)])  # two too late, one in time
    observe.collect_closed(windows, out)
    assert closed() == [(at(0), "view", 3), (at(60), "view", 1), (at(180), "error", 2)]


def test_changed_windows_are_written_alone(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    windows = observe.windowed(stream(spark, folder), window="1 hour", late="1 day")
    feed(spark, folder, 1, [event(i, 10 * i) for i in range(30)])
    first = {r.window.start: r.n for r in observe.collect_changed(windows, ["window", "event_type"], out).collect()}
    assert first == {at(60 * h): 6 for h in range(5)}
    feed(spark, folder, 2, [event(99, 61), event(100, 600)])
    both = {r.window.start: (r.n, float(r.total)) for r in observe.collect_changed(windows, ["window", "event_type"], out).collect()}
    assert both == {at(60 * h): (6 + (h == 1), 6.0 + (h == 1)) for h in range(5)} | {at(600): (1, 1.0)}
    sizes = sorted(spark.read.parquet(out).groupBy("batch").count().toPandas()["count"])
    assert sizes[0] == 2 and sizes[-1] == 5  # the second batch wrote two windows, not all


def test_sessions_join_late_events(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    found = observe.sessions(stream(spark, folder), "user", gap="30 minutes", late="1 hour")
    feed(spark, folder, 1, [event(1, 0, "a"), event(2, 50, "a"), event(3, 10, "b", "error")])
    observe.collect_closed(found, out)
    feed(spark, folder, 2, [event(4, 25, "a", "error"), event(5, 600, "c")])  # bridges the two sessions of a
    observe.collect_closed(found, out)
    feed(spark, folder, 3, [event(6, 15, "b"), event(7, 900, "c")])  # too late
    observe.collect_closed(found, out)
    got = sorted((r.user, r.start, r.end, r.n, r.errors) for r in spark.read.parquet(out).collect())
    assert got == [("a", at(0), at(80), 3, 1), ("b", at(10), at(40), 1, 1), ("c", at(600), at(630), 1, 0)]


def test_regressions_on_a_stream_equal_those_of_a_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "system string, ts timestamp, qps double, avg_latency double, error_rate double"
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "1", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        rows = [(f"s{i % 3}", at(i), 100.0 + (i * 37) % 50, 5.0 + i % 4, (i % 6) / 50) for i in range(20)]
        found = observe.regressions(stream(spark, folder, schema), "system")
        feed(spark, folder, 1, rows[:10], schema)
        observe.collect_closed(found, out)
        feed(spark, folder, 2, [*rows[10:], ("s0", at(-5), 1.0, 1.0, 0.0)], schema)  # the last one is older than what is known
        observe.collect_closed(found, out)
        cols = ["system", "ts", "qps_change", "latency_change", "error_rate_change", "severity", "has_regression"]
        got = sorted((tuple(r) for r in spark.read.parquet(out).select(*cols).collect()), key=repr)
        whole = history.compare_previous(spark.createDataFrame(rows, schema), by=["system"]).select(*cols)
        want = sorted([*(tuple(r) for r in whole.collect()), ("s0", at(-5), None, None, None, "none", False)], key=repr)
        assert got == want and {r[5] for r in got} >= {"none", "severe"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
