"""Building blocks for large inputs: shared storage, skew-proof lookups, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from over 1 / HOT of all rows on (or 1 / (4 * shuffle partitions), if that is less), so there are at most so many hot keys, however large the table is.
HOT, MOST_HOT = 2000, 200_000
#: Bits of a bitmap of hashes: 16 MB, whatever the input.
BITMAP = 1 << 27


#: Paths of tables staged in the open scratch blocks of a thread, the innermost last.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder there that all its machines share")
        base = "file://" + tempfile.mkdtemp(prefix="perfloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, what: str, onto: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no more than a reread. onto: a staged table that df is added to."""
    path = onto._staged_at if onto is not None else f"{shared_dir(df.sparkSession)}/perfloom/{what}-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    if onto is None and (blocks := getattr(_OPEN, "blocks", None)):
        blocks[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dealt(df: DataFrame, what: str, by: Column, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """df, staged in so many parts by a hash: all of it, and each part, which may be removed once it has been read."""
    path = f"{shared_dir(df.sparkSession)}/perfloom/{what}-{uuid.uuid4().hex}"
    df.withColumn("_part", F.pmod(by, F.lit(parts))).write.partitionBy("_part").option("compression", "zstd").parquet(path)
    if blocks := getattr(_OPEN, "blocks", None):
        blocks[-1].append(path)
    read = df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", "true")
    out = []
    for k in range(parts):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={k}")
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)  # a part without rows has none
        out.append(read.parquet(f"{path}/_part={k}"))
        out[-1]._staged_at = f"{path}/_part={k}"
    return read.parquet(path), out


def slimmed(df: DataFrame, what: str, onto: DataFrame | None = None) -> DataFrame:
    """staged, for what shuffles much: Spark drops the shuffle files of an action that has ended when the driver collects its garbage, so it does."""
    out = staged(df, what, onto)
    df.sparkSession._jvm.System.gc()
    return out


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged within the block are removed at its end, but for those given to keep (which outlast it, up to a block around it).

    What leaves the block must be read from kept tables alone.
    """
    blocks = _OPEN.blocks = getattr(_OPEN, "blocks", [])
    mine: list[str] = []
    kept: list[str] = []
    blocks.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._staged_at)
        return df

    try:
        yield keep
    finally:
        blocks.pop()
        if blocks:
            blocks[-1].extend(kept)
        for path in mine:
            if path not in kept:
                remove(spark, path)


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table on keys, safe against hot keys.

    table has one row per key, and in column weight how many of the total rows have that key. Keys with over 1 / HOT of all
    rows (or less, with many shuffle partitions, but not under 1 / MOST_HOT) are that many at most, so they are broadcast;
    the others, each clearly less than a partition's share, meet in a shuffle. rows is read twice: give a staged or cheap
    one. how: inner or left. Keys must not be null.
    """
    share = min(max(HOT, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_HOT)
    hot = F.broadcast(table.where(F.col(weight) * share > F.lit(total)))
    few = table.where(F.col(weight) * share <= F.lit(total))
    few_rows = rows.join(hot.select(*keys), list(keys), "left_anti")
    return rows.join(hot, list(keys), "inner").unionByName(few_rows.join(few, list(keys), how))


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bit for the low bits of each hash (column h); what comes to the driver are at most BITMAP / 64 rows."""
    bits = hashes.select(F.col("h").bitwiseAND(F.lit(BITMAP - 1)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    del words
    release()
    return out.view(np.uint8)


def release() -> None:
    """Gives memory that Arrow holds on the driver back to the system, after a table has come there."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes whose bit is set."""
    bit = h & (BITMAP - 1)
    return np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node that can be reached.

    Large-star and small-star steps in turn (Kiveris et al. 2014), each as a grouped minimum and a lookup; each round is
    staged, and the round before it removed. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = (n, mark)
        old = now
        with scratch(spark) as keep:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("w"))
            large = attach(both, least, ["u"], "w", 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            large = staged(large, "large-star")
            n = large.count()
            least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w"))
            small = attach(large, least, ["a"], "w", n)
            now = small.where("b <> m").select("b", "m").union(least.select("a", "m")).toDF("a", "b").distinct()
            now = keep(staged(now, "small-star"))
        remove(spark, old._staged_at)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
