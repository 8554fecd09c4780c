import json
import random

import pytest
from pyspark.sql import functions as F

from perfloom.operators import history
from perfloom.sources import readers

#: Time, qps, average and p99 latency of recorded runs, and the severity of each against the one before.
RUNS = [
    ("2026-04-13T20:04:15.826647", 292.3, 2.96365, 6.959, "none"),
    ("2026-04-13T20:08:22.258847", 387.746, 2.40217, 7.663, "none"),
    ("2026-04-13T20:15:15.165341", 377.129, 2.32365, 7.51, "none"),
    ("2026-04-13T20:18:54.783246", 329.773, 2.86431, 7.447, "moderate"),
    ("2026-04-13T20:27:15.503976", 287.582, 2.55733, 6.847, "moderate"),
    ("2026-04-13T20:28:53.169176", 380.384, 2.04578, 6.405, "none"),
    ("2026-04-13T20:30:50.346511", 325.198, 2.57618, 7.037, "moderate"),
    ("2026-04-13T20:32:16.315574", 289.643, 2.74517, 6.822, "moderate"),
    ("2026-04-13T20:34:11.325729", 296.612, 2.87095, 7.72, "none"),
    ("2026-04-13T20:37:01.849459", 349.883, 2.34195, 6.967, "none"),
    ("2026-04-13T20:39:59.388091", 375.638, 2.57649, 6.258, "none"),
    ("2026-04-13T20:44:33.594419", 349.636, 2.71629, 11.08, "minor"),
    ("2026-04-13T21:08:07.603717", 299.466, 2.54028, 6.995, "moderate"),
    ("2026-04-13T21:16:00.051510", 306.687, 2.78009, 7.34, "none"),
    ("2026-04-13T21:16:13.269662", 324.824, 3.2905, 8.915, "none"),
]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("history") / "history.json"
    p.write_text(json.dumps([{"timestamp": t, "qps": q, "avg_latency": a, "p99_latency": p9, "error_rate": 0.0, "target_qps": 400.0, "notes": ""} for t, q, a, p9, _ in RUNS]))
    return readers.snapshot_history(spark, str(p))


def test_severities(runs):
    got = history.compare_previous(runs).orderBy("ts").collect()
    assert [r.severity for r in got] == [r[4] for r in RUNS]
    assert got[0].qps_change is None and abs(got[1].qps_change - 32.6534) < 1e-3 and abs(got[1].latency_change + 18.9456) < 1e-3


def test_trends(runs):
    metrics = ["qps", "avg_latency", "p99_latency"]
    one = {r.metric: r for r in history.trend_first_last(runs, metrics).collect()}
    two = {r.metric: r for r in history.trend_half_split(runs, metrics).collect()}
    for m, a, la, b, lb in (("qps", 11.126924, "improving", -4.696066, "stable"), ("avg_latency", 11.02863, "improving", 7.871931, "increasing"), ("p99_latency", 28.107487, "improving", 8.957398, "increasing")):
        assert abs(one[m].change_percent - a) < 1e-5 and one[m].trend == la
        assert abs(two[m].change_percent - b) < 1e-5 and two[m].trend == lb
    assert history.trend_first_last(runs.limit(1), ["qps"]).first().trend == "unknown"
    assert history.trend_half_split(runs.limit(1), ["qps"]).first().trend == "insufficient_data"


def test_broken_history_is_empty(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text("not json")
    assert readers.snapshot_history(spark, str(p)).count() == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 101)] + [("b", 7.0)] * 3 + [("c", None)], "k string, v double")
    got = {r.k: r.p for r in history.nearest_rank(df, "k", "v", {"p": 0.99}).collect()}
    assert got == {"a": 100.0, "b": 7.0}
    rng = random.Random(1)
    v = [float(rng.randrange(20)) for _ in range(57)]
    df = spark.createDataFrame([("a", x) for x in v], "k string, v double")
    for q in (0.0, 0.5, 0.9, 0.99):
        assert history.nearest_rank(df, "k", "v", {"p": q}).first().p == sorted(v)[min(int(57 * q), 56)]


def test_saturation(spark):
    rows = [("a", 1, 10.0, 0.0, True), ("a", 2, 99.0, 0.5, False), ("a", 3, 20.0, 0.01, True), ("a", 4, 30.0, 0.05, True), ("a", 5, 40.0, 0.0, True), ("b", 1, 5.0, 0.9, True)]
    got = {r.s: (r.max_achievable, r.bottleneck) for r in history.saturation(spark.createDataFrame(rows, "s string, level int, actual_qps double, error_rate double, success boolean"), "s").collect()}
    assert got == {"a": (20.0, 4), "b": (0.0, 1)}


def test_time_range_is_inclusive(runs):
    assert history.time_range(runs, RUNS[1][0], RUNS[3][0]).count() == 3
    assert history.trailing(runs, 1).count() == 15
    assert runs.select(F.max("qps")).first()[0] == 387.746


def test_nearest_rank_of_odd_values(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1e300, float("inf"), float("-inf"), float("nan"), 1.0, 1.0, 2.0, -2.0, 0.5] + [rng.uniform(-5, 5) * 10 ** rng.randrange(-9, 9) for _ in range(300)] + [7.0] * 200
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("b", 3.0), ("c", None)], "k string, v double")
    order = sorted(values, key=lambda x: (x != x, x))
    for q in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        got = {r.k: r.p for r in history.nearest_rank(df, "k", "v", {"p": q}).collect()}
        want = order[min(int(len(order) * q), len(order) - 1)]
        assert got["b"] == 3.0 and "c" not in got and (got["a"] == want or got["a"] != got["a"] and want != want)
    plan = history.nearest_rank(df, "k", "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2


def test_total_ranks(spark):
    from perfloom.operators.ranking import total_ranks

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, g string, v int").repartition(5)
    got = {r.seq: r["rank"] for r in total_ranks(df, F.desc("v"), F.col("seq")).collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    assert got == want
    got = {r.seq: r["rank"] for r in total_ranks(df, F.desc("v"), F.col("seq"), by=["g"]).collect()}
    for g in ("a", "b", None):
        assert [got[r[0]] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))] == list(range(1, sum(r[1] == g for r in rows) + 1))
    assert total_ranks(df.limit(0), F.col("seq")).count() == 0
