"""Small keyed tables that several writers may change: data files are never overwritten, versions are.

A version is a file _versions/<n> that names the folder of each bucket's rows and the operations that led here. A writer makes
the buckets that it changes anew, in a folder of its own, and then creates the next version's file, which only one writer can;
one that comes too late starts again from what is there. What a failed writer leaves is named by no version. An operation
that is told again by its name changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of operations that a version remembers; seconds until a version's file that stays empty counts as a failed writer's.
OPERATIONS, PATIENCE = 1000, 5.0


class KeyedTable:
    """A table with one row for each key, in buckets by the keys' hash; keys may be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _at(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        store, place = self._at(folder)
        return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []

    def _manifest(self, n: int) -> dict | None:
        """What a version says; None for one whose writer failed. An empty file may still be written, so it is waited for."""
        until = time.time() + PATIENCE
        while True:
            store, place = self._at(f"_versions/{n}")
            with_size = store.getFileStatus(place).getLen()
            if with_size:
                source = store.open(place)
                try:
                    return json.loads(bytes(source.readAllBytes()).decode())
                except ValueError:
                    pass
                finally:
                    source.close()
            if time.time() > until:
                return None
            time.sleep(0.1)

    def version(self) -> tuple[int, dict]:
        """The highest number taken (0 for none), and what the newest whole version says."""
        numbers = sorted((int(x) for x in self._names("_versions") if x.isdigit()), reverse=True)
        said = next((m for n in numbers if (m := self._manifest(n)) is not None), {"buckets": {}, "operations": []})
        return (numbers[0] if numbers else 0), said

    def _rows(self, said: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}/_bucket={b}" for b, folder in said["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.version()[1])

    def _commit(self, n: int, said: dict) -> bool:
        """Whether this writer was the one to make version n."""
        store, place = self._at(f"_versions/{n}")
        try:
            out = store.create(place, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or store.exists(place):
                return False
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def _replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        names = [f"_k{i}" for i in range(len(self.keys))]
        same = F.lit(True)
        for k, name in zip(self.keys, names, strict=True):
            same &= F.col(k).eqNullSafe(F.col(name))
        return old.join(new.select(*(F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True))), same, "left_anti").unionByName(new)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, *, operation: str | None = None) -> int:
        """Takes rows in (one a key) and tells the number of the version that has them.

        combine: makes the new rows of some buckets out of their old ones and the changes; by default a change takes the place
        of the row with its key. operation: a name, by which the same merge, run again, is known and left out.
        """
        operation = operation or uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        changes = changes.select(*self.spark.createDataFrame([], self.schema).columns) if combine is None else changes
        touched = sorted(r.b for r in changes.select(bucket.alias("b")).distinct().collect())  # self.buckets at most
        while True:
            n, said = self.version()
            if operation in said["operations"]:
                return n
            folder = f"data-{uuid.uuid4().hex}"
            rows = (combine or self._replaced)(self._rows(said, touched), changes)
            rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            made = {x.removeprefix("_bucket="): folder for x in self._names(folder) if x.startswith("_bucket=")}
            kept = {b: f for b, f in said["buckets"].items() if int(b) not in touched}
            if self._commit(n + 1, {"buckets": kept | made, "operations": [*said["operations"], operation][-OPERATIONS:]}):
                return n + 1

    def clear(self) -> int:
        """A version without rows; operations stay known."""
        while True:
            n, said = self.version()
            if self._commit(n + 1, said | {"buckets": {}}):
                return n + 1
