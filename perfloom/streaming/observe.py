"""A continuous observer: windows, sessions and regressions of an event stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import judged
from ..operators.scale import shared_dir


def windowed(events: DataFrame, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and errors by window; events: ts (timestamp), event_type, value. Works on streams and tables alike; on streams, events later than allowed are dropped."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))


def sessions(events: DataFrame, by: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, end, n and errors of each run of events with no pause of gap or longer; late events join sessions that are still open."""
    e = events.withWatermark("ts", late)
    found = e.groupBy(by, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return found.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "errors")


def collect_closed(results: DataFrame, path: str):
    """Runs a stream over what is there now, in append mode: each window or session is written once, when the watermark has passed it."""
    q = results.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def collect_changed(results: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Runs a stream over what is there now, in update mode: a batch writes what it changed, and the newest of each key counts.

    A batch that is run again overwrites its own folder.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = results.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in results.columns if c not in keys]
    done = results.sparkSession.read.schema(T.StructType([*results.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", path).parquet(path)
    return done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


CHANGES = "{by} string, ts timestamp, qps double, avg_latency double, error_rate double, qps_change double, latency_change double, error_rate_change double"


class LastSnapshot(StatefulProcessor):
    """Keeps a series' last snapshot and tells how each next one differs from it."""

    def __init__(self, by: str, keep_ms: int):
        self.by, self.keep_ms = by, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, qps double, avg_latency double, error_rate double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("ts")
        old = self.last.get() if self.last.exists() else None
        out = []
        for r in new.itertuples(index=False):
            now = (r.ts.to_pydatetime(), float(r.qps), float(r.avg_latency), float(r.error_rate))
            change = (None, None, None)
            late = old is not None and now[0] < old[0]
            if old is not None and not late:
                part = lambda a, b: (a - b) / b * 100 if b > 0 else 0.0
                change = (part(now[1], old[1]), part(now[2], old[2]), now[3] - old[3])
            out.append((key[0], *now, *change))
            if not late:
                old = now
        self.last.update(old)
        yield pd.DataFrame(out, columns=[c.split()[0].format(by=self.by) for c in CHANGES.split(", ")]).astype({c: "float64" for c in ("qps_change", "latency_change", "error_rate_change")})

    def close(self) -> None:
        pass


def regressions(snapshots: DataFrame, by: str, *, keep_ms: int = 3_600_000) -> DataFrame:
    """Each snapshot (by, ts, qps, avg_latency, error_rate) of a stream against the one before it in its series, with severity.

    The last snapshot of a series is state that lives keep_ms after it came; after that, as at the beginning, there is nothing
    to compare with. A snapshot older than the last one isn't compared and doesn't take its place. Needs a state store for
    several columns: spark.sql.streaming.stateStore.providerClass with RocksDBStateStoreProvider.
    """
    some = snapshots.select(F.col(by).cast("string").alias(by), "ts", *(F.col(c).cast("double").alias(c) for c in ("qps", "avg_latency", "error_rate")))
    return judged(some.groupBy(by).transformWithStateInPandas(LastSnapshot(by, keep_ms), CHANGES.format(by=by), "Append", "ProcessingTime"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, run until all of it is read; all windows come out, the open ones too."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    windows = windowed(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    done = collect_changed(windows, ["window", "event_type"], f"{shared_dir(spark)}/perfloom/observed-{uuid.uuid4().hex}")
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("ts"), "event_type", "n", F.col("total").cast("double").alias("total"))
