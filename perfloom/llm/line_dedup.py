"""Line deduplication by windows of three consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, staged

#: ASCII white space within lines: a line that has another character is filled.
BLANK = " \t\x0b\x0c\r"


def repeated_windows(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """(_id, _th, _at): windows of size lines that occurred before. docs: _id, _th, _lines, _at (indices of filled lines)."""
    start = F.sequence(F.lit(0), F.size("_full") - size)
    body = lambda j: [F.element_at("_lines", F.element_at("_full", j + 1 + k) + 1) for k in range(size)]
    each = F.transform(start, lambda j: F.struct(j.alias("_at"), F.xxhash64(*body(j)).alias("_h1"), F.xxhash64(F.lit("#"), *body(j)).alias("_h2")))
    windows = staged(docs.where(F.size("_full") >= size).select("_id", "_th", F.inline(each)), "windows")
    place = F.struct("_id", "_th", "_at")
    again = windows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    return attach(windows, staged(again, "repeated-windows"), ["_h1", "_h2"], "_n", windows.count()).where(place > F.col("_first")).select("_id", "_th", "_at")


def dedup_lines(docs: DataFrame, *, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs, with text replaced, and _n_lines and _n_removed.

    Lines are what \\n separates; size filled lines in a row (blank ones between are passed over) make a window. A window
    that occurred before (in a smaller doc_id, nulls first, or earlier in the same document) goes: each line that such a
    window covers is removed, the rest stays as it is. Documents are told apart by doc_id and text, so rows that are equal
    in both are one document and come back alike. A null text stays null and has no lines; fewer filled lines than size make
    no window.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(key).alias("_id"), F.xxhash64(body).alias("_th"), F.split(body, "\n").alias("_lines"))
    mine = mine.withColumn("_full", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.ltrim(F.element_at("_lines", i + 1), F.lit(BLANK)) != ""))
    gone = repeated_windows(mine, size=size).distinct().groupBy("_id", "_th").agg(F.collect_list("_at").alias("_gone")).toDF("_id2", "_th2", "_gone")
    both = mine.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    none = F.array().cast("array<int>")
    covered = F.flatten(F.transform(F.coalesce("_gone", none), lambda j: F.transform(F.sequence(j, j + size - 1), lambda k: F.element_at("_full", k + 1))))
    both = both.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered))
    new = F.when(F.col("_gone").isNull(), F.col(f"_row.`{text}`")).otherwise(F.array_join(F.transform("_kept", lambda i: F.element_at("_lines", i + 1)), "\n"))
    n_lines = F.when(F.col(f"_row.`{text}`").isNull(), 0).otherwise(F.size("_lines"))
    return both.select(*(new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns), n_lines.cast("long").alias("_n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("_n_removed"))


#: DuckDB SQL for the query: the same windows, compared as texts.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
f AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, r, i AS i1, lead(i) OVER p AS i2, lead(i, 2) OVER p AS i3,
             line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS body
      FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, r) AS occurrence FROM w WHERE body IS NOT NULL),
gone AS (SELECT doc_id, unnest([i1, i2, i3]) AS i FROM n WHERE occurrence > 1),
g AS (SELECT DISTINCT doc_id, i FROM gone),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, text FROM k
"""
