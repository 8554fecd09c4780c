"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import HOT, attach, bitmap_of, components, marked, release, remove, scratch, shared_dir, staged

__all__ = ["HOT", "WORD", "attach", "bitmap_of", "components", "keyed", "marked", "release", "remove", "salted_lookup", "scratch", "shared_dir", "staged", "without"]

#: Lower-casing of A-Z only, and the white space that ends a word (space, \t, \n, \v, \f, \r), are what bytes.lower() and
#: bytes.split() do, so Python code works on UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """_id, _th (hash of the text) and _text (UTF-8 bytes, null as empty) of each row: rows that agree in _id and _th are one document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(body).alias("_th"), body.cast("binary").alias("_text"))


def without(docs: DataFrame, gone: DataFrame, *, once: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of docs whose doc_id and text hash are not in gone (doc_id, _th). once: of rows that agree in both, one stays.

    Null ids and null texts (as empty) are compared like others. Columns of docs may have any names.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    mine = docs.select(whole.alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    gone = gone.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "_th").distinct()
    left = mine.join(gone, ["_id", "_th"], "left_anti")
    if once:
        left = left.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))).where("_n = 1")
    return left.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def salted_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: str, salts: int = 64) -> DataFrame:
    """rows inner-joined with a table of one row per key; each key is dealt over salts partitions by a hash of column spread."""
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("_salt", F.pmod(F.hash(F.col(spread)), F.lit(salts)))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
