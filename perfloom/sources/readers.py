"""Readers of the engine's file formats. A missing or broken history reads as an empty one."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import LogSource

SNAPSHOT = "timestamp string, qps double, avg_latency double, p99_latency double, error_rate double, target_qps double, notes string"
SUGGESTION = "title string, description string, pseudocode string, priority int, risk_level string, expected_gain string, implementation_steps array<string>, self_confidence double"
RECORD = "timestamp string, system string, target_qps double, actual_qps double, avg_latency double, p99_latency double, error_rate double, threads int, ops int, suggestions array<struct<priority: int, risk_level: string, adopted: boolean>>, metadata map<string, string>"


def snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of a JSON array file, with ts; text that isn't JSON gives no rows."""
    df = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("ts", F.col("timestamp").try_cast("timestamp_ntz")).where("qps is not null")


def record_store(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON object with an array records."""
    df = spark.read.schema(f"records array<struct<{RECORD}>>, updated_at string").option("multiLine", True).json(path)
    return df.select(F.inline("records"))


def model_history(spark: SparkSession, path: str) -> DataFrame:
    """source_model, adopted, total of a JSON object keyed by model."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, struct<adopted: bigint, total: bigint>>")).alias("source_model", "h")).select("source_model", F.coalesce("h.adopted", F.lit(0)).alias("adopted"), F.coalesce("h.total", F.lit(0)).alias("total"))


def log_lines(spark: SparkSession, path: str, newest: int = 3, tail: int = 0) -> DataFrame:
    """file, pos (offset of its first byte), line of the newest files that a path or pattern names; with tail only the last lines of each, read from its end."""
    spark.dataSource.register(LogSource)
    rows = spark.read.format(LogSource.name()).option("newest", newest).option("tail", tail).load(path)
    return rows.select("file", F.col("start").alias("pos"), "line")


def with_headers(lines: DataFrame) -> DataFrame:
    """One text per file: a header line with its name, then its lines."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return lines.groupBy("file").agg(body.alias("b")).select("file", F.concat(F.lit("=== "), "file", F.lit(" ===\n"), "b").alias("text"))


def config_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the *.conf files in a folder."""
    return spark.read.option("pathGlobFilter", "*.conf").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def source_files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))
    return df if names is None else df.where(F.col("path").isin(names))


def key_values(text: Column, comment: str = "#") -> Column:
    """A map out of lines `key:value`, without comments."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains(":") & ~x.startswith(comment))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), x.alias("x")))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p.k)), lambda k: F.struct(k, F.element_at(F.transform(F.filter(pairs, lambda p: p.k == k), lambda p: F.substr(p.x, F.length(k) + 2)), -1))))


def suggestion_file(text: Column) -> Column:
    """An array of suggestions out of JSON that is an array, an object with suggestions, or one suggestion."""
    array = F.from_json(text, f"array<struct<{SUGGESTION}>>")
    inner = F.from_json(text, f"suggestions array<struct<{SUGGESTION}>>")["suggestions"]
    one = F.from_json(text, SUGGESTION)
    return F.when(F.trim(text).startswith("["), array).otherwise(F.coalesce(inner, F.when(one["title"].isNotNull(), F.array(one))))


def command_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Captured command outputs, one JSON object a line."""
    return spark.read.schema("command string, stdout string, stderr string, returncode int, description string").json(path)


def status_value(text: Column, name: str) -> Column:
    """The number behind a name in a status text (name, white space, number a line), or null."""
    return F.regexp_extract(text, rf"(?m)^\s*{re.escape(name)}\s+([\d.]+)", 1).try_cast("double")


#: What a configuration has where the file says nothing.
DEFAULTS = {"weight_engine": {"confidence_threshold": 0.3, "default_model_weight": 0.7, "max_suggestions": 5, "history_db_path": "./data/history.json"}, "models": [], "systems": [], "output_dir": "./output", "data_dir": "./data"}


def config(path: str) -> dict:
    """A YAML configuration (JSON without PyYAML, as it is a subset), with defaults, and whole-string ${NAME} replaced from the environment."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return with_defaults(json.loads(text))
    return with_defaults(yaml.safe_load(text) or {})


def with_defaults(data: dict) -> dict:
    data = resolve(data)
    return DEFAULTS | data | {"weight_engine": DEFAULTS["weight_engine"] | (data.get("weight_engine") or {})}


def resolve(value: object) -> object:
    if isinstance(value, dict):
        return {k: resolve(v) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v) for v in value]
    if isinstance(value, str) and (m := re.fullmatch(r"\$\{(\w+)\}", value)):
        return os.environ.get(m[1], "")
    return value
