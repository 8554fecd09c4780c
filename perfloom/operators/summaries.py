"""Summaries, orders and short lists of suggestions, verifications, runs and analysis results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import gap_to_target
from .ranking import total_ranks
from .suggestions import CATEGORIES, categories, risk_order

RISKS = ["low", "medium", "high"]


def is_success(error: Column, suggestions: Column) -> Column:
    """An analysis went well: no error, and at least one suggestion."""
    return error.isNull() & F.coalesce(F.size(suggestions) > 0, F.lit(False))


def collected(results: DataFrame) -> DataFrame:
    """One row per suggestion of each analysis that went well: model_name, pos, and the suggestion's fields.

    results: model_name, suggestions (array of structs), error.
    """
    ok = results.where(is_success(F.col("error"), F.col("suggestions")))
    return ok.select("model_name", F.posexplode("suggestions").alias("pos", "s")).select("model_name", "pos", "s.*")


def bag_union(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all, duplicates kept; columns by name, missing ones are null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def as_report_row(s: DataFrame) -> DataFrame:
    """seq and document: what a report shows of a suggestion, as JSON; the base weight stays out."""
    shown = ["title", "description", "pseudocode", "priority", "risk_level", "expected_gain", "source_model", "self_confidence"]
    return s.select("seq", F.to_json(F.struct(*shown)).alias("document"))


def named(df: DataFrame, names: Sequence[str], column: str = "name") -> DataFrame:
    """Rows whose name is in the list; an empty list takes all."""
    return df.where(F.col(column).isin(list(names))) if names else df


def enabled(df: DataFrame, names: Sequence[str] = (), column: str = "name") -> DataFrame:
    """Rows that aren't switched off (column enabled; null counts as on), of the names in the list if there are any."""
    return named(df.where(F.coalesce("enabled", F.lit(True))), names, column)


def point(df: DataFrame, name: str, order: str, column: str = "name") -> DataFrame:
    """The first row of that name, or none."""
    return df.where(F.col(column) == name).orderBy(order).limit(1)


def first_distinct(df: DataFrame, column: str, order: Sequence[str], k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Of each value of a column the first row, and of these the first k (of each by)."""
    w = Window.partitionBy(*by, column).orderBy(*order)
    once = df.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    if not by:
        return once.orderBy(*order).limit(k).drop("_r")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def slowest(log: DataFrame, k: int = 10, seconds: str = "query_time", tie: str = "id") -> DataFrame:
    return log.orderBy(F.desc(seconds), tie).limit(k)


def next_levels(levels: DataFrame, current: float, k: int = 3) -> DataFrame:
    """The first k levels (by pos) of at least 0.8 times the current rate."""
    return levels.where(F.col("level") >= 0.8 * current).orderBy("pos").limit(k)


def best(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """The row of the highest value, whatever the metric; the first on ties."""
    return df.orderBy(F.desc(metric), tie).limit(1)


def latest(df: DataFrame, k: int, ts: str = "ts") -> DataFrame:
    return df.orderBy(F.desc(ts)).limit(k)


def by_debate_score(s: DataFrame) -> DataFrame:
    """s with score and rank: priority times 1.2, 1 or 0.7 by risk, highest first, then in order."""
    factor = F.when(F.col("risk_level") == "low", 1.2).when(F.col("risk_level") == "high", 0.7).otherwise(1.0)
    s = s.withColumn("score", F.coalesce("priority", F.lit(3)) * factor)
    return total_ranks(s, F.desc("score"), F.col("seq"))


def by_priority(s: DataFrame, k: int = 5) -> DataFrame:
    return s.orderBy(F.desc("priority"), "seq").limit(k)


def by_confidence(v: DataFrame) -> DataFrame:
    """v with rank: surest first, then in order."""
    return total_ranks(v, F.desc("confidence"), F.col("seq"))


def suggestion_summary(s: DataFrame) -> DataFrame:
    """One row: total, by_risk and by_model (maps; a label `a + b` counts for both), top_title and top_weight of the first by rank."""
    models = F.transform(F.split("source_model", r" \+ "), lambda x: F.trim(x))
    risk = s.groupBy(F.lit("risk").alias("what"), F.col("risk_level").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    model = s.select(F.explode(models).alias("name")).groupBy(F.lit("model").alias("what"), "name").agg(F.count(F.lit(1)).alias("n"))
    counts = risk.union(model).groupBy().agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == x, F.struct("name", "n"))))).alias(f"by_{x}") for x in ("risk", "model")))
    top = s.agg(F.count(F.lit(1)).alias("total"), F.min_by("title", "rank").alias("top_title"), F.coalesce(F.min_by("final_weight", "rank"), F.lit(0.0)).alias("top_weight"))
    return top.crossJoin(counts).select("total", "by_risk", "by_model", "top_title", "top_weight")


def _grouped(s: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Each suggestion with its place (rank) in its group, by seq, and a row a group: n, top_priority."""
    return total_ranks(s, F.col("seq"), by=[by]), s.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("top_priority"))


def grouped_by_risk(s: DataFrame) -> DataFrame:
    """pos, risk_level, n, top_priority and, a row for each suggestion, rank, seq and title, for low, medium and high; an empty group has one row, without them."""
    levels = s.sparkSession.createDataFrame([(i, r) for i, r in enumerate(RISKS)], "pos int, risk_level string")
    rows, per = _grouped(s.where(F.col("risk_level").isin(RISKS)).select("risk_level", "seq", "title", "priority"), "risk_level")
    heads = F.broadcast(levels.join(per, "risk_level", "left").select("pos", "risk_level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top_priority", F.lit(0)).alias("top_priority")))
    every = rows.join(heads, "risk_level").select("pos", "risk_level", "n", "top_priority", "rank", "seq", "title")
    return every.unionByName(heads.where("n = 0"), allowMissingColumns=True)


def grouped_by_priority(s: DataFrame) -> DataFrame:
    """pos (0 for the highest), priority, n and, a row for each suggestion, its rank in the group, seq and title."""
    rows, per = _grouped(s.select("priority", "seq", "title"), "priority")
    heads = per.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("priority"))) - 1)  # a row a priority
    return rows.join(F.broadcast(heads.withColumnRenamed("priority", "_p")), F.col("priority").eqNullSafe(F.col("_p"))).select("pos", "priority", "n", "rank", "seq", "title")


def cross_validation(s: DataFrame, sure: float = 0.5) -> DataFrame:
    """One row: high_confidence (final_weight over the bound), low_confidence, valid, consensus_score, topic_groups."""
    high = F.count_if(F.col("final_weight") > sure)
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "")
    n = F.count(F.lit(1))
    return s.agg(high.alias("high_confidence"), (n - high).alias("low_confidence"), (high > 0).alias("valid"), F.when(n > 0, high / n.cast("double")).otherwise(0.0).alias("consensus_score"), F.count_distinct(F.array_join(F.slice(words, 1, 2), " ")).alias("topic_groups"))


def mean(value: Column, digits: str = "decimal(30,12)") -> Column:
    """An average that doesn't depend on the order of rows; null for none."""
    return F.try_divide(F.sum(value.cast(digits)).cast("double"), F.count(value))


def suite_summary(runs: DataFrame) -> DataFrame:
    """One row: total_runs, successful_runs, avg_qps and best_qps (over successful runs; 0 without any). runs: qps, success."""
    ok = F.when(F.col("success"), F.col("qps"))
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if("success").alias("successful_runs"), F.coalesce(mean(ok), F.lit(0.0)).alias("avg_qps"), F.coalesce(F.max(ok), F.lit(0.0)).alias("best_qps"))


def sample_summary(samples: DataFrame, interval: float = 60.0) -> DataFrame:
    """One row: n, avg_qps, max_qps, min_qps, avg_latency and the time that n samples span."""
    n = F.count(F.lit(1))
    return samples.agg(n.alias("n"), mean(F.col("qps")).alias("avg_qps"), F.max("qps").alias("max_qps"), F.min("qps").alias("min_qps"), mean(F.col("avg_latency")).alias("avg_latency"), (n * F.lit(interval)).alias("duration"))


def verification_summary(v: DataFrame, qps: float, target: float) -> DataFrame:
    """One row about verified suggestions (seq, title, risk_level, passed, confidence, is_valid): counts of valid ones, also by risk, their mean confidence, the surest title, the gap."""
    ok = F.col("is_valid")
    counts = [F.count_if(ok & (F.col("risk_level") == r)).alias(r) for r in RISKS]
    first = F.min_by("title", F.struct((-F.col("confidence")).alias("c"), "seq"))
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), *counts, F.sum(F.when(ok, F.col("passed"))).cast("long").alias("checks_passed"), F.coalesce(mean(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"), first.alias("top_title")).withColumn("gap_percent", gap_to_target(F.lit(float(qps)), F.lit(float(target))))


def agent_summary(v: DataFrame) -> DataFrame:
    """One row: n, valid, avg_confidence and highest_confidence over all, distinct issues in order. v also has issues (array); kinds of issues are few."""
    issues = v.select(F.explode("issues").alias("issue")).distinct().agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"), F.coalesce(mean(F.col("confidence")), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("highest_confidence")).crossJoin(F.broadcast(issues))


def action_items(s: DataFrame, score: int) -> DataFrame:
    """pos, action, priority, details: first steps out of ranked suggestions and the score card (fixed texts)."""
    spark, order = s.sparkSession, F.col("rank")
    low = s.where("risk_level = 'low'").orderBy(order).limit(1).select(F.lit(1).alias("pos"), F.concat(F.lit("立即实施 "), "title").alias("action"), F.lit("high").alias("priority"), F.lit("低风险优化，可快速验证效果").alias("details"))
    top = s.orderBy(F.desc("priority"), order).limit(2).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("priority"), order)) + 1)
    top = top.select("pos", F.col("title").alias("action"), F.lit("medium").alias("priority"), F.concat(F.lit("优先级 "), F.col("priority").cast("string"), F.lit("，预期 "), "expected_gain").alias("details"))
    base = [(0, "优先解决基础瓶颈", "high", "系统评分较低，建议先从低风险优化入手")] if score < 60 else []
    return spark.createDataFrame(base, "pos int, action string, priority string, details string").union(low).union(top)


def category_lists(s: DataFrame, k: int = 3) -> DataFrame:
    """pos, category and the first k titles of each category that has any, in the order of the categories."""
    names = [c for _, c in CATEGORIES] + ["other"]
    tagged = categories(s).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("rank"))).where(F.col("r") <= k)
    per = tagged.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title", "risk_level"))), lambda x: F.concat(x.title, F.lit(" ("), x.risk_level, F.lit(")"))).alias("titles"))
    return per.withColumn("pos", F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int"))


def capped_by_risk(s: DataFrame, k: int = 2) -> DataFrame:
    """The first k of each risk by rank."""
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("risk_level").orderBy("rank"))).where(F.col("_r") <= k).drop("_r").orderBy(risk_order(F.col("risk_level")), "rank")
