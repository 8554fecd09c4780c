"""Operators on metric histories: nearest ranks, regressions, trends, summaries, saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import succeeded, threads_for


#: Value ranges for an octave (a factor of two), and what lies over all of them.
RANGES, OVER = 64, 1 << 18


def value_range(value: Column) -> Column:
    """A whole number that never falls as the value grows: its sign and its logarithm in steps; NaN is the greatest, as in sorting."""
    v = value.cast("double")
    steps = lambda x: F.greatest(F.lit(-OVER + 2.0), F.least(F.lit(OVER - 2.0), F.floor(F.log2(x) * RANGES))).cast("int") + OVER
    return F.when(F.isnan(v), 2 * OVER + 1).when(v > 0, steps(v)).when(v < 0, -steps(-v)).otherwise(0)


def nearest_rank(rows: DataFrame, key: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """For each key the value at place min(int(n * q), n - 1) of the sorted values; not SQL's percentile.

    Equal values are counted first, in the one pass over rows; these counts, shuffled once, serve both steps: counts by range
    of values tell which range has the place, and only that one's values are sorted.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    told = c.withColumn("_b", value_range(F.col(value)))
    sizes = told.groupBy(key, "_b").agg(F.sum("_c").alias("_m"))
    each = Window.partitionBy(key)
    sizes = sizes.withColumn("_n", F.sum("_m").over(each)).withColumn("_lo", F.sum("_m").over(each.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"))
    wanted = F.inline(F.array(*(F.struct(F.lit(name).alias("_name"), F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1).alias("_at")) for name, q in ranks.items())))
    wanted = sizes.select(key, "_b", "_lo", "_m", wanted).where("_at >= _lo and _at < _lo + _m")
    some = told.join(wanted.groupBy(key, "_b").agg(F.first("_lo").alias("_lo"), F.collect_list(F.struct("_name", "_at")).alias("_wanted")), [key, "_b"])
    upto = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("_hi", F.col("_lo") + F.sum("_c").over(upto))
    here = lambda name: F.exists("_wanted", lambda x: (x["_name"] == name) & (x["_at"] < F.col("_hi")) & (x["_at"] >= F.col("_hi") - F.col("_c")))
    return some.groupBy(key).agg(*(F.max(F.when(here(name), F.col(value))).alias(name) for name in ranks))


def _changed(now: Column, then: Column) -> Column:
    return F.when(then > 0, (now - then) / then * 100).otherwise(F.lit(0.0))


def judged(df: DataFrame) -> DataFrame:
    """Severity from qps_change (per cent) and error_rate_change (absolute); latency has no say."""
    q, e = F.coalesce("qps_change", F.lit(0.0)), F.coalesce("error_rate_change", F.lit(0.0))
    level = F.when((q < -20) | (e > 0.05), "severe").when((q < -10) | (e > 0.02), "moderate").when((q < -5) | (e > 0.01), "minor").otherwise("none")
    return df.withColumn("has_regression", (q < -5) | (e > 0.01)).withColumn("severity", level)


def compare_previous(snapshots: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """Each snapshot against the one before it, by ts; the first of each series has no change."""
    w = Window.partitionBy(*by).orderBy("ts")
    old = {c: F.lag(c).over(w) for c in ("qps", "avg_latency", "error_rate")}
    df = snapshots.select("*", *(v.alias(f"_{k}") for k, v in old.items()))
    df = df.withColumn("qps_change", F.when(F.col("_qps").isNotNull(), _changed(F.col("qps"), F.col("_qps"))))
    df = df.withColumn("latency_change", F.when(F.col("_qps").isNotNull(), _changed(F.col("avg_latency"), F.col("_avg_latency"))))
    return judged(df.withColumn("error_rate_change", F.col("error_rate") - F.col("_error_rate"))).drop("_qps", "_avg_latency", "_error_rate")


def compare_baseline(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the earliest one (a single row, so it is broadcast)."""
    base = snapshots.agg(F.min_by(F.struct("qps", "avg_latency", "error_rate"), "ts").alias("_b"))
    df = snapshots.crossJoin(F.broadcast(base))
    df = df.withColumn("qps_change", _changed(F.col("qps"), F.col("_b.qps"))).withColumn("latency_change", _changed(F.col("avg_latency"), F.col("_b.avg_latency")))
    return judged(df.withColumn("error_rate_change", F.col("error_rate") - F.col("_b.error_rate"))).drop("_b")


def trailing(rows: DataFrame, days: int, asof: Column | None = None) -> DataFrame:
    """Rows of the last days before asof (default: the latest ts)."""
    last = F.broadcast(rows.agg(F.max("ts").alias("_asof"))) if asof is None else None
    df = rows.crossJoin(last) if last is not None else rows.withColumn("_asof", asof)
    return df.where(F.col("ts") >= F.col("_asof") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_asof")


def trend_first_last(snapshots: DataFrame, metrics: list[str], days: int = 7, *, higher_is_better: bool = True) -> DataFrame:
    """Last against first value in the window: over 5 % up is improving, down degrading; under two points unknown.

    By default a rising latency counts as improving too, as the sign rule is the same for all metrics.
    """
    rows = trailing(snapshots, days)
    one = rows.select("ts", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))))
    a = one.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", "ts").alias("first"), F.max_by("v", "ts").alias("last"))
    c = _changed(F.col("last"), F.col("first")) * (1 if higher_is_better else -1)
    known = F.col("n") >= 2
    label = F.when(~known, "unknown").when(c > 5, "improving").when(c < -5, "degrading").otherwise("stable")
    return a.select("metric", "n", F.when(known, F.col("first")).otherwise(0.0).alias("previous"), F.when(known, F.col("last")).otherwise(0.0).alias("current"), F.when(known, c).otherwise(0.0).alias("change_percent"), label.alias("trend"))


def trend_half_split(snapshots: DataFrame, metrics: list[str], days: int = 7) -> DataFrame:
    """Average of the later half against that of the earlier: over 5 % up is increasing, down decreasing."""
    rows = trailing(snapshots, days)
    w = Window.partitionBy("metric")
    one = rows.select("ts", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(30,12)").alias("v")) for m in metrics))))
    one = one.withColumn("r", F.row_number().over(w.orderBy("ts"))).withColumn("n", F.count(F.lit(1)).over(w))
    early = F.col("r") <= F.floor(F.col("n") / 2)
    mean = lambda cond: F.sum(F.when(cond, F.col("v"))).cast("double") / F.count_if(cond)
    a = one.groupBy("metric").agg(F.max("n").alias("n"), F.when(F.max("n") > 1, mean(early)).alias("a"), F.when(F.max("n") > 1, mean(~early)).alias("b"), F.min("v").cast("double").alias("min_value"), F.max("v").cast("double").alias("max_value"))
    label = F.when(F.col("n") < 2, "insufficient_data").when(F.col("b") > F.col("a") * 1.05, "increasing").when(F.col("b") < F.col("a") * 0.95, "decreasing").otherwise("stable")
    return a.select("metric", "n", F.coalesce(_changed(F.col("b"), F.col("a")), F.lit(0.0)).alias("change_percent"), "min_value", "max_value", label.alias("trend"))


def time_range(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= ts <= end; either may be left out."""
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return rows if end is None else rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def record_summary(records: DataFrame, by: str | None = "system") -> DataFrame:
    """Runs, successes, means, the best rate and the time of the last record by seq, of each system; without by one row, zeros for no records."""
    ok = succeeded(F.col("actual_qps"), F.col("target_qps"), F.col("error_rate"))
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c).cast("decimal(30,6)")).cast("double"), n), F.lit(0.0))
    p99 = [mean("p99_latency").alias("avg_p99")] if "p99_latency" in records.columns else []
    aggs = [n.alias("total"), F.count_if(ok).alias("successes"), F.coalesce(F.try_divide(F.count_if(ok).cast("double"), n), F.lit(0.0)).alias("success_rate"), mean("actual_qps").alias("avg_qps"), mean("avg_latency").alias("avg_latency"), *p99, F.coalesce(F.max("actual_qps"), F.lit(0.0)).alias("max_qps"), F.max_by("ts", "seq").alias("latest")]
    return records.groupBy(*([by] if by else [])).agg(*aggs)


def adoption_stats(records: DataFrame) -> DataFrame:
    """Nested suggestions: totals, and counts by priority and risk; missing ones count as 3 and medium."""
    s = records.select("system", F.explode("suggestions").alias("s"))
    p, r = F.coalesce("s.priority", F.lit(3)), F.coalesce("s.risk_level", F.lit("medium"))
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if("s.adopted").alias("adopted"), (F.count_if("s.adopted") / F.count(F.lit(1)).cast("double")).alias("adoption_rate")]
    aggs += [F.count_if(p == i).alias(f"priority_{i}") for i in range(1, 6)] + [F.count_if(r == x).alias(f"risk_{x}") for x in ("low", "medium", "high")]
    return s.groupBy("system").agg(*aggs)


def saturation(levels: DataFrame, by: str) -> DataFrame:
    """Highest actual rate before the first successful level with an error rate of 5 % or more, which is the bottleneck.

    levels: by, level, actual_qps, error_rate, success; unsuccessful levels are passed over.
    """
    w = Window.partitionBy(by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    ok = levels.where("success").withColumn("_bad", F.col("error_rate") >= 0.05)
    ok = ok.withColumn("_over", F.max("_bad").over(w))
    return ok.groupBy(by).agg(F.coalesce(F.max(F.when(~F.col("_over"), F.col("actual_qps"))), F.lit(0.0)).alias("max_achievable"), F.min(F.when(F.col("_bad"), F.col("level"))).alias("bottleneck"))


def optimal_config(levels: DataFrame, by: str) -> DataFrame:
    """level, actual_qps, p99_latency, score, threads, ops of the successful level with an error rate under 5 % of the best score (rate over 400, and latency).

    Without any: level, rate, latency and score 0, 4 threads, 100 operations.
    """
    score = 0.6 * F.col("actual_qps") / 400 + 0.4 * (10.0 / (F.col("p99_latency") + 0.1))
    good = F.col("success") & (F.col("error_rate") < 0.05)
    b = F.max(F.when(good, F.struct(score.alias("score"), (-F.col("level")).alias("_l"), "level", "actual_qps", "p99_latency"))).alias("b")
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c)
    none = F.col("b").isNull()
    threads = F.when(none, 4).otherwise(threads_for(F.col("b.actual_qps"))).alias("threads")
    return levels.groupBy(by).agg(b).select(by, zero("level"), zero("actual_qps"), zero("p99_latency"), zero("score"), threads, F.when(none, 100).otherwise(200).alias("ops"))
