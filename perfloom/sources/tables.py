"""Adapters: the engine's entities, drawn from the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (day), value, is_error: one row per request."""
    return table(spark, sf_dir, "events").select(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts"), "value", (F.col("event_type") == "error").alias("is_error"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per day: ts, qps, avg_latency, p50_latency, p99_latency (nearest rank), error_rate, target_qps."""
    from ..operators.history import nearest_rank

    rows = samples(spark, sf_dir)
    agg = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("s"), F.count_if("is_error").alias("e"))
    ranks = nearest_rank(rows, "ts", "value", {"p50_latency": 0.5, "p99_latency": 0.99})
    n = F.col("n").cast("double")
    return agg.join(ranks, "ts").select("ts", (n / F.lit(86400.0)).alias("qps"), (F.col("s").cast("double") / n).alias("avg_latency"), "p50_latency", "p99_latency", (F.col("e") / n).alias("error_rate"), F.lit(0.004).alias("target_qps"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: seq, system, ts, target_qps, actual_qps, avg_latency, error_rate, threads, suggestions (nested)."""
    lines = table(spark, sf_dir, "lineitem")
    money = F.col("l_extendedprice").cast("decimal(20,4)") * (1 - F.col("l_discount").cast("decimal(10,4)"))
    risk = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    item = F.struct((1 + F.col("l_linenumber") % 5).cast("int").alias("priority"), risk.alias("risk_level"), (F.col("l_linestatus") == "F").alias("adopted"))
    per = lines.groupBy("l_orderkey").agg(F.sum(money).cast("double").alias("actual_qps"), (F.sum(F.col("l_quantity").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))).alias("avg_latency"), (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)).cast("double")).alias("error_rate"), F.count(F.lit(1)).cast("int").alias("threads"), F.collect_list(item).alias("suggestions"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("system"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("target_qps"), "actual_qps", "avg_latency", "error_rate", "threads", "suggestions")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: seq, title (four words), description (the whole text), priority, risk_level, source_model and so on."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"\s+", 6), lambda w: w != "")  # only the first part can be empty, so the four are among five; the sixth is the rest
    k = F.col("doc_id")
    return d.select(
        k.alias("seq"),
        F.array_join(F.slice(words, 1, 4), " ").alias("title"),
        F.col("text").alias("description"),
        F.when(k % 7 == 0, "# 无代码").otherwise(F.concat(F.lit("lock(m) {"), F.when(k % 5 == 0, "").otherwise("}"))).alias("pseudocode"),
        (1 + k % 5).cast("int").alias("priority"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("risk_level"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("QPS +"), (k % 40).cast("string"), F.lit("%"))).alias("expected_gain"),
        (k % 4).cast("int").alias("n_steps"),
        F.col("source").alias("source_model"),
        ((k % 11) / F.lit(10.0)).alias("self_confidence"),
        F.lit(1.0).alias("base_weight"),
    )


def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_model, total, adopted from labelled documents."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "source").join(lab, "doc_id").groupBy(F.col("source").alias("source_model")).agg(F.count(F.lit(1)).alias("total"), F.sum("quality").cast("long").alias("adopted"))
