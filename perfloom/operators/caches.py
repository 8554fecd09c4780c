"""What is known of files and analyses already, keyed by content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import KeyedTable


def digests(files: DataFrame) -> DataFrame:
    """path, digest (MD5 of the content), lines, size. files: path, content."""
    text = F.coalesce("content", F.lit(""))
    return files.select("path", F.md5(text).alias("digest"), F.size(F.split(text, "\n")).cast("long").alias("lines"), F.octet_length(text).cast("long").alias("size"))


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache lacks, or has with another content."""
    d = digests(files)
    return files.join(d.join(cache.select("path", "digest"), ["path", "digest"], "left_anti").select("path"), "path", "left_semi")


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in place of those of the same path."""
    return cache.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def stats(cache: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: files, lines, analyses and hits. analyses: hits of each kept analysis."""
    a = cache.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return a.crossJoin(analyses.agg(F.count(F.lit(1)).alias("analyses"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")))


#: What an analysis depends on, in the order of its key.
KEYED = ["avg_latency", "error_rate", "p99_latency", "qps"]


def metrics_key() -> Column:
    """MD5 of the metrics columns as JSON with sorted names; missing ones are 0."""
    parts = [F.concat(F.lit(f'"{c}": '), F.coalesce(F.col(c).cast("string"), F.lit("0"))) for c in KEYED]
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def fresh(cache: DataFrame, asof: Column, ttl: int = 3600) -> DataFrame:
    """Entries (cached_at: timestamp) that are younger than ttl seconds at a given time."""
    return cache.where(F.unix_timestamp(asof.cast("timestamp")) - F.unix_timestamp(F.col("cached_at").cast("timestamp")) < ttl)


#: Kept analyses, by a digest of what they depend on.
ANALYSIS = "key string, result string, cached_at timestamp, hits long"


def remember(table: KeyedTable, analyses: DataFrame, *, operation: str | None = None) -> int:
    """Keeps analyses (key, result, cached_at) in place of those with their keys, not yet used."""
    return table.merge(analyses.withColumn("hits", F.lit(0).cast("long")), operation=operation)


def recalled(table: KeyedTable, asof: Column, ttl: int = 3600) -> DataFrame:
    """What is kept and, at a given time, younger than ttl seconds."""
    return fresh(table.read(), asof, ttl)


def forget(table: KeyedTable) -> int:
    """Clears a cache: a new version without rows."""
    return table.clear()
