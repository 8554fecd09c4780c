"""Whole runs: benchmark, observation, analysis and verification one after the other, each step a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, suggestions, summaries

Step = Callable[[dict], object]


def pipeline(steps: list[tuple[str, Step]], context: dict, *, stop: bool = True) -> dict:
    """Runs named steps in order, each with the context so far; a step's result is there as name_result, an error as name_error.

    stop: no further step runs after one that failed.
    """
    context = dict(context)
    for name, step in steps:
        try:
            context[f"{name}_result"] = step(context)
        except Exception as e:  # a step may be anything; what went wrong is part of the result
            context[f"{name}_error"] = e
            if stop:
                break
    return context


def refined(analyse: Callable[[DataFrame | None, int], DataFrame], rounds: int = 2) -> DataFrame:
    """Suggestions of all rounds with column round (from 1); each round sees those of the rounds before (none: null). Duplicates stay."""
    every = None
    for k in range(1, rounds + 1):
        new = analyse(every, k).withColumn("round", F.lit(k))
        every = new if every is None else summaries.bag_union(every, new)
    return every


def cross_validated(verify: Callable[[DataFrame | None, int], DataFrame], rounds: int = 2, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the first k verified suggestions by round and rank, counts by round) of several verification rounds; the same suggestion may come twice."""
    every = refined(verify, rounds)
    first = every.orderBy("round", F.desc("confidence"), "seq").limit(k)
    return first, every.groupBy("round").agg(F.count(F.lit(1)).alias("verified"), F.count_if("is_valid").alias("valid"))


def optimisation(runs: DataFrame, results: DataFrame, adoptions: DataFrame, target: float) -> dict[str, DataFrame]:
    """The standard run: suite summary, regressions, ranked suggestions of all models that answered, their verification and conflicts.

    runs: ts, qps, avg_latency, p99_latency, error_rate, success. results: model_name, suggestions, error. adoptions: model
    history. Metrics of the latest run are what gaps are measured by.
    """

    def analyse(c: dict) -> DataFrame:
        rows = summaries.collected(c["results"]).withColumn("source_model", F.coalesce("source_model", "model_name"))
        return suggestions.aggregate(rows.withColumn("seq", F.xxhash64("model_name", "pos")) if "seq" not in rows.columns else rows, c["adoptions"])

    def verify(c: dict) -> DataFrame:
        found = c["analyse_result"]
        return suggestions.verified(found).join(found.select("seq", "title"), "seq")

    steps: list[tuple[str, Step]] = [
        ("benchmark", lambda c: summaries.suite_summary(c["runs"])),
        ("observe", lambda c: history.compare_previous(c["runs"])),
        ("analyse", analyse),
        ("verify", verify),
        ("conflicts", lambda c: suggestions.conflicts(c["analyse_result"])),
        ("summary", lambda c: summaries.verification_summary(c["verify_result"], summaries.latest(c["runs"], 1).first().qps, target)),
    ]
    done = pipeline(steps, {"runs": runs, "results": results, "adoptions": adoptions})
    if failed := next((v for k, v in done.items() if k.endswith("_error")), None):
        raise failed
    return {name: done[f"{name}_result"] for name, _ in steps}
