"""Writers of the engine's results."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import succeeded
from .versions import KeyedTable


def append_snapshots(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def with_record_id(df: DataFrame) -> DataFrame:
    """df with record_id: the first 12 hex digits of the MD5 of time, rate and target."""
    return df.withColumn("record_id", F.substring(F.md5(F.concat_ws(":", F.col("ts").cast("string"), F.col("actual_qps").cast("string"), F.col("target_qps").cast("string"))), 1, 12))


def export_csv(records: DataFrame, path: str) -> None:
    ok = succeeded(F.col("actual_qps"), F.col("target_qps"), F.col("error_rate"))
    some = lambda c, t: F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c)
    at = F.col("timestamp") if "timestamp" in records.columns else F.col("ts").alias("timestamp")
    records.select(at, "system", "target_qps", "actual_qps", "avg_latency", some("p99_latency", "double"), "error_rate", "threads", some("ops", "int"), ok.alias("success")).write.option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def latest_adoptions(events: DataFrame, keep: int = 100) -> DataFrame:
    """Model history out of adoption events (source_model, at, adopted): totals, and the last details."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_model")
    df = events.withColumn("_r", F.row_number().over(w.orderBy(F.desc("at"))))
    return df.groupBy("source_model").agg(F.count(F.lit(1)).alias("total"), F.count_if("adopted").alias("adopted"), F.array_sort(F.collect_list(F.when(F.col("_r") <= keep, F.struct("at", "adopted")))).alias("details"))


HISTORY = "source_model string, total long, adopted long, details array<struct<at: timestamp, adopted: boolean>>"


def update_history(table: KeyedTable, events: DataFrame, *, operation: str | None = None, keep: int = 100) -> int:
    """Adds adoption events (source_model, at: timestamp, adopted) to a model history (HISTORY, by source_model); the same operation counts once."""

    def added(old: DataFrame, new: DataFrame) -> DataFrame:
        last = F.array_sort(F.flatten(F.collect_list("details")))  # of two rows a model
        both = old.unionByName(new).groupBy("source_model").agg(F.sum("total").alias("total"), F.sum("adopted").alias("adopted"), last.alias("_all"))
        return both.select("source_model", "total", "adopted", F.slice("_all", F.greatest(F.size("_all") - keep + 1, F.lit(1)), F.lit(keep)).alias("details"))

    return table.merge(latest_adoptions(events, keep), added, operation=operation)


def reset_history(table: KeyedTable) -> int:
    return table.clear()


def markdown_report(title: str, ranked: DataFrame) -> DataFrame:
    """One row, report: the ranked suggestions as Markdown."""
    line = F.format_string("## %d. %s\n\n- model: %s\n- risk: %s\n- priority: %d\n\n%s\n", "rank", "title", "source_model", "risk_level", "priority", "description")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("text")))), lambda x: x.text), "\n")
    return ranked.agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("report"))


def stamped(name: str, at: str) -> str:
    """A report's file name: name_yyyyMMdd_HHmmss.md for an ISO time."""
    return f"{name}_{datetime.fromisoformat(at):%Y%m%d_%H%M%S}.md"


def export_config(config: dict, path: str) -> None:
    """A configuration as JSON, keys of models masked, or for .yaml and .yml as YAML as it is."""
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            yaml.safe_dump(config, f, allow_unicode=True, sort_keys=False)
        else:
            models = [m | ({"api_key": "${API_KEY}"} if m.get("api_key") else {}) for m in config.get("models", [])]
            json.dump(config | {"models": models}, f, ensure_ascii=False, indent=2)
