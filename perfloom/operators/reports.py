"""Texts for people: reports and prompts, put together from small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import history, summaries


def lines_in_order(df: DataFrame, order: str, line: Column) -> Column:
    """For agg(): the lines of all rows, in order, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line), "\n")


def regression_report(snapshots: DataFrame, recent: int = 5) -> DataFrame:
    """One row, report: the latest snapshot, its change, the trends of rate and latency, the last snapshots."""
    judged = history.compare_previous(snapshots)
    number = lambda c, form: F.format_string(form, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    state = F.concat(F.lit("QPS: "), number("qps", "%.1f"), F.lit("\navg latency: "), number("avg_latency", "%.2f ms"), F.lit("\nP99 latency: "), number("p99_latency", "%.2f ms"), F.lit("\nerror rate: "), F.format_string("%.2f%%", F.col("error_rate") * 100), F.lit("\nregression: "), F.col("severity"))
    now = judged.agg(F.max_by(state, "ts").alias("now"))
    trend = history.trend_first_last(snapshots, ["qps", "avg_latency"]).where("trend <> 'unknown'")
    trends = trend.agg(lines_in_order(trend, "metric", F.format_string("%s: %s (%+.1f%%)", "metric", "trend", "change_percent")).alias("trends"))
    last = summaries.latest(snapshots, recent)
    table = last.agg(lines_in_order(last, "ts", F.format_string("%s %10.1f %9.2fms %9.2f%%", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "qps", "avg_latency", F.col("error_rate") * 100)).alias("last"))
    return now.crossJoin(trends).crossJoin(table).select(F.concat_ws("\n\n", F.lit("# Performance"), "now", "trends", "last").alias("report"))


def diagnosis_report(found: DataFrame, by: str) -> DataFrame:
    """by and report. found: by, problem, severity, confidence, symptoms, causes, commands (arrays), suggestions (array of title, command)."""
    bullets = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    head = F.format_string("problem: %s\nseverity: %s\nconfidence: %.0f%%", "problem", "severity", F.col("confidence") * 100)
    fixes = F.transform("suggestions", lambda x: F.concat(x.title, F.lit(": "), x.command))
    return found.select(by, F.concat_ws("\n\n", head, bullets("symptoms", F.col("symptoms")), bullets("causes", F.col("causes")), bullets("suggestions", fixes), bullets("commands", F.slice("commands", 1, 5))).alias("report"))


def domain_report(metrics: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row, report: score card of one metrics row (qps, avg_latency, p99_latency, error_rate, target_qps), suggestions, categories, roadmap, first steps.

    ranked: suggestions with rank. The score decides on the first steps, so it is looked up before.
    """
    from .suggestions import roadmap

    c = [F.col(x) for x in ("qps", "avg_latency", "p99_latency", "error_rate")]
    card = metrics.select("*", M.score_card(*c).alias("score"), M.strengths(*c).alias("good"), M.bottlenecks(*c).alias("bad"), M.achievable(F.col("qps"), F.col("target_qps")).alias("near")).withColumn("grade", M.grade(F.col("score")))
    score = card.first().score
    state = F.format_string("score: %d (%s)\nqps: %.1f of %.1f\nachievable: %s\ngood: %s\nbad: %s", "score", "grade", "qps", "target_qps", F.col("near").cast("string"), F.array_join("good", ", "), F.array_join("bad", ", "))
    head = card.agg(F.first(state).alias("a"))
    rows = ranked.agg(lines_in_order(ranked, "rank", F.format_string("%d. %s [%s, priority %d, %s]", "rank", "title", "risk_level", "priority", "expected_gain")).alias("b"))
    lists = summaries.category_lists(ranked)
    kinds = lists.agg(lines_in_order(lists, "pos", F.concat("category", F.lit(": "), F.array_join("titles", "; "))).alias("c"))
    way = roadmap(ranked)
    steps = way.agg(lines_in_order(way, "step", F.format_string("%d. %s", "step", "title")).alias("d"))
    todo = summaries.action_items(ranked, score)
    items = todo.agg(lines_in_order(todo, "pos", F.concat("action", F.lit(" ("), "priority", F.lit(")"))).alias("e"))
    part = lambda name, col: F.concat(F.lit(f"## {name}\n"), F.coalesce(F.col(col), F.lit("")))
    return head.crossJoin(rows).crossJoin(kinds).crossJoin(steps).crossJoin(items).select(F.concat_ws("\n\n", part("Metrics", "a"), part("Suggestions", "b"), part("Categories", "c"), part("Roadmap", "d"), part("First steps", "e")).alias("report"))


#: The order to go in, and what to heed, by risk.
ORDER = [("low", "1. Low risk (at once)"), ("medium", "2. Medium risk (after tests)"), ("high", "3. High risk (after review)")]
VERIFY = ["1. One suggestion at a time.", "2. Measure after each.", "3. Roll back what doesn't help.", "4. Note what each one gained."]


def state_table(metrics: DataFrame) -> DataFrame:
    """One row, a: the metrics row (qps, avg_latency, p50_latency, p99_latency, error_rate, target_qps) as a Markdown table with what has been reached."""
    gap = M.gap_to_target(F.col("qps"), F.col("target_qps"))
    reached = F.when(F.col("qps") >= F.col("target_qps"), "reached").otherwise(F.format_string("short by %.1f%%", gap))
    rows = [
        F.lit("| metric | now | target | state |\n|:-|:-|:-|:-|"),
        F.format_string("| QPS | %.1f | %.1f | %s |", "qps", "target_qps", reached),
        *(F.format_string(f"| {name} latency | %.2f ms | - | - |", f"{c}_latency") for name, c in (("average", "avg"), ("P50", "p50"), ("P99", "p99"))),
        F.format_string("| error rate | %.2f%% | < 1%% | %s |", F.col("error_rate") * 100, F.when(M.is_healthy(F.col("error_rate")), "good").otherwise("bad")),
    ]
    return metrics.select(F.concat_ws("\n", *rows).alias("a"))


def suggestion_text() -> Column:
    """A ranked suggestion as Markdown: its attributes, its analysis, its code (fenced, if it isn't yet), its steps."""
    level = F.when(F.col("priority") >= 4, "high").when(F.col("priority") >= 2, "medium").otherwise("low")
    head = F.format_string("### %d. %s\n\n- priority: %s %s\n- risk: %s\n- gain: %s\n- model: %s\n- confidence: %.0f%%", "rank", "title", F.repeat(F.lit("*"), F.col("priority")), level, "risk_level", "expected_gain", "source_model", F.col("self_confidence") * 100)
    code = F.when(F.col("pseudocode").contains("```"), F.col("pseudocode")).otherwise(F.concat(F.lit("```\n"), "pseudocode", F.lit("\n```")))
    steps = F.array_join(F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat_ws("\n\n", head, "description", code, F.when(F.size("steps") > 0, steps))


def optimization_report(metrics: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row, report: the state, all suggestions, the first two of each risk in the order to go in, and how to verify; without suggestions only the state and that there are none.

    ranked: the few suggestions of a ranking, with rank and steps (array).
    """
    every = ranked.agg(F.count(F.lit(1)).alias("n"), lines_in_order(ranked, "rank", F.concat(suggestion_text(), F.lit("\n"))).alias("b"))
    some = summaries.capped_by_risk(ranked, 2)
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("risk_level") == risk, F.struct("rank", "title")))), lambda x: F.concat(F.lit("- "), x.title)), "\n").alias(risk) for risk, _ in ORDER]
    go = F.concat_ws("\n\n", *(F.when(F.col(risk) != "", F.concat(F.lit(f"**{head}**\n"), F.col(risk))) for risk, head in ORDER))
    texts = state_table(metrics).crossJoin(every).crossJoin(some.agg(*lists))
    none = F.concat_ws("\n\n", F.lit("# Optimization"), "a", F.lit("No suggestions: nothing stands out."))
    full = F.concat_ws("\n\n", F.lit("# Optimization"), "a", F.format_string("## %d suggestions", "n"), "b", F.lit("## Order"), go, F.lit("## Verification"), F.lit("\n".join(VERIFY)))
    return texts.select(F.when(F.col("n") > 0, full).otherwise(none).alias("report"))


def short_summary(metrics: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """One row, report: rate and target, and the first k suggestions with 80 characters of each description."""
    top = ranked.where(F.col("rank") <= k)
    line = F.format_string("%d. **%s** (%s risk)\n   %s...", "rank", "title", "risk_level", F.substring("description", 1, 80))
    head = metrics.select(F.format_string("QPS %.1f of %.1f", "qps", "target_qps").alias("a"))
    return head.crossJoin(top.agg(lines_in_order(top, "rank", line).alias("b"))).select(F.concat_ws("\n\n", "a", F.nullif("b", F.lit(""))).alias("report"))


def prompt(metrics: Column, logs: Column, source: Column, *, last: int = 5000, first: int = 3000) -> Column:
    """Metrics, the end of the logs and the beginning of the source as one text; parts that are missing stay out."""
    some = lambda head, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{head}:\n"), text))
    return F.concat_ws("\n\n", some("metrics", metrics), some("logs", F.right(logs, F.lit(last))), some("source", F.substring(source, 1, first)))
