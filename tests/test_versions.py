import datetime as dt

import pytest
from pyspark.sql import functions as F

from perfloom.operators import caches
from perfloom.sources import sinks, versions
from perfloom.sources.versions import KeyedTable

SCHEMA = "k string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/table", SCHEMA, ["k"], buckets=3)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(t):
    return sorted((tuple(r) for r in t.read().collect()), key=repr)


def test_merges_clear_and_null_keys(spark, table):
    assert held(table) == [] and table.version()[0] == 0
    assert table.merge(rows(spark, ("a", 1), ("b", 2), (None, 3))) == 1
    assert table.merge(rows(spark, ("b", 5), (None, 6), ("c", 7))) == 2
    assert held(table) == [("a", 1), ("b", 5), ("c", 7), (None, 6)]
    assert table.merge(rows(spark)) == 3 and len(held(table)) == 4
    table.clear()
    assert held(table) == []


def test_an_operation_counts_once(spark, table):
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    for _ in range(2):
        table.merge(rows(spark, ("a", 1)), add, operation="first")
    table.merge(rows(spark, ("a", 10)), add, operation="second")
    assert held(table) == [("a", 11)] and table.version()[0] == 2


def test_two_writers_lose_nothing(spark, table):
    """Another writer commits while this one works on the version before: it starts again from the newer one."""
    table.merge(rows(spark, ("a", 1)))
    seen = []

    def slow(old, new):
        if not seen:
            KeyedTable(spark, table.path, SCHEMA, ["k"], buckets=3).merge(rows(spark, ("a", 100), ("z", 9)))
        seen.append(sorted(r.v for r in old.collect()))
        return old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))

    table.merge(rows(spark, ("a", 10)), slow)
    assert seen[0] == [1] and 100 in seen[1] and held(table) == [("a", 110), ("z", 9)]


def test_a_failed_write_changes_nothing(spark, table, monkeypatch):
    table.merge(rows(spark, ("a", 1)))
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        table.merge(rows(spark, ("a", 2)), lambda old, new: new.withColumn("v", boom("v")))
    assert held(table) == [("a", 1)] and table.version()[0] == 1
    store, place = table._at("_versions/2")  # a writer that died between making the file and filling it
    store.create(place, False).close()
    monkeypatch.setattr(versions, "PATIENCE", 0.2)
    assert held(table) == [("a", 1)]
    assert table.merge(rows(spark, ("b", 3))) == 3 and held(table) == [("a", 1), ("b", 3)]


def test_model_history_and_analysis_cache(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    history = KeyedTable(spark, f"file://{tmp_path}/history", sinks.HISTORY, ["source_model"])
    events = lambda *e: spark.createDataFrame([(m, at(i), ok) for m, i, ok in e], "source_model string, at timestamp, adopted boolean")
    for _ in range(2):
        sinks.update_history(history, events(("m", 1, True), ("m", 2, False), ("n", 3, True)), operation="day 1", keep=3)
    sinks.update_history(history, events(("m", 5, True), ("m", 6, True)), operation="day 2", keep=3)
    got = {r.source_model: (r.total, r.adopted, [d.at for d in r.details]) for r in history.read().collect()}
    assert got == {"m": (4, 3, [at(2), at(5), at(6)]), "n": (1, 1, [at(3)])}
    sinks.reset_history(history)
    assert history.read().count() == 0
    cache = KeyedTable(spark, f"file://{tmp_path}/cache", caches.ANALYSIS, ["key"])
    caches.remember(cache, spark.createDataFrame([("x", "r1", at(0)), ("y", "r2", at(50))], "key string, result string, cached_at timestamp"))
    assert {r.key for r in caches.recalled(cache, F.lit(at(70))).collect()} == {"y"}
    caches.remember(cache, spark.createDataFrame([("x", "r3", at(65))], "key string, result string, cached_at timestamp"))
    assert {(r.key, r.result) for r in caches.recalled(cache, F.lit(at(70))).collect()} == {("x", "r3"), ("y", "r2")}
    caches.forget(cache)
    assert caches.recalled(cache, F.lit(at(70))).count() == 0
