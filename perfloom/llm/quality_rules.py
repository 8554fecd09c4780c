"""Quality rules from how often lines occur across the documents of a host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, salted_lookup, staged

SCHEMA = "doc_id long, _th long, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _lines array<struct<h: long, w: int>>, _row long"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """How many words lie in windows of n words that the list holds more than once, the first time included."""
    if len(words) <= n:
        return 0
    grams = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often, covered, end = {g for g, c in Counter(grams).items() if c > 1}, 0, 0
    for i, g in enumerate(grams):
        if g in often:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def text_stats(body: bytes) -> tuple[list[int], list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then the distinct normalised lines with their words."""
    words = body.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(body) - len(body.translate(None, b"#*$%&|<>"))
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in body.split(b"\n"):
        if parts := line.split():
            dup += line in seen
            seen.add(line)
            h = signed(xxhash.xxh3_64_intdigest(b" ".join(parts).lower()))
            lines[h] = lines.get(h, 0) + len(parts)
    return [len(words), chars, symbols, dup, repeat_words(words)], [{"h": h, "w": w} for h, w in lines.items()]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    for b in batches:
        found = [text_stats(t.as_py()) for t in b.column(3)]
        cols = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols, pa.array([f[1] for f in found], kind), b.column(4)], names=["doc_id", "_th", "_host", *STATS, "_lines", "_row"])


def quality_rules(docs: DataFrame, *, max_docs: int = 10, min_docs: int = 6, share: float = 0.05, left: float = 0.5, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words and kept per row; _th and _gone for stripped().

    A normalised line (white space squeezed, A-Z lower-cased) is above the limit where at least max_docs different texts of
    its host hold it, however large the host; or, in a small host, at least min_docs and over share of the host's texts. A
    document is kept if it doesn't fail the base rules (under 10 words, or over 20 % of its words in repeated five-word
    windows) and at least the part left of its words stays once such lines are gone. Rows with equal texts in one host count
    once there, and each is judged. Null texts are empty and fail; null hosts are one host; other columns are not read. _th
    is the text's hash, _gone holds the hashes of the lines that go (null: none).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("_th"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), body.cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    base = staged(rows.mapInArrow(scan, SCHEMA), "quality-rules")
    lines = base.select("_row", "_host", F.inline("_lines"))
    once = base.groupBy("_host", "_th").agg(F.min("_row").alias("_row"))
    once = staged(once, "host-texts")
    counted = base.select("_row", "_host", "_lines").join(once.select("_row"), "_row", "left_semi").select("_host", F.inline("_lines"))
    often = counted.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= min(min_docs, max_docs))
    hosts = once.groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    limit = (F.col("_docs") >= max_docs) | (F.col("_docs") >= min_docs) & (F.col("_docs") > share * F.col("_host_docs"))
    above = salted_lookup(often, hosts, ["_host"], "h").where(limit).select("_host", "h")
    # Copies of a text aren't in _docs, so how many rows hold a line is counted anew, for the lookup.
    above = staged(lines.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("_uses")).join(above, ["_host", "h"]), "frequent-lines")
    total = base.agg(F.sum(F.size("_lines"))).first()[0] or 0
    gone = attach(lines, above, ["_host", "h"], "_uses", total).groupBy("_row").agg(F.sum("w").cast("long").alias("_words"), F.collect_list("h").alias("_gone"))
    out = base.drop("_lines").join(gone, "_row", "left").withColumn("n_removed_words", F.coalesce("_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stays = F.col("n_words") - F.col("n_removed_words") >= F.lit(left) * F.col("n_words")
    return out.select("doc_id", *STATS, failed.alias("base_failed"), "n_removed_words", (~failed & stays).alias("kept"), "_th", "_gone")


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for body, gone in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            lines, gone = body.as_py().split(b"\n"), set(gone or ())
            out.append(b"\n".join(x for x in lines if not gone or not (parts := x.split()) or signed(xxhash.xxh3_64_intdigest(b" ".join(parts).lower())) not in gone))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def stripped(docs: DataFrame, judged: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text of the documents that quality_rules keeps, without the lines above the limit; rows equal in both come once."""
    body = F.coalesce(F.col(text), F.lit(""))
    mine = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("_th"), body.cast("binary").alias("_text"))
    kept = judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "_gone").dropDuplicates(["_id", "_h"])
    both = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h"))).dropDuplicates(["doc_id", "_th"])
    return both.select("doc_id", "_text", "_gone").mapInArrow(without_lines, "doc_id long, text string")


#: DuckDB SQL for quality_rules with its default parameters, over documents with distinct doc_id.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
per AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY 1),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM often WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, host, hash(t) AS th, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT doc_id, host, th, line, translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY 1),
h AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY 1),
above AS (SELECT host, norm FROM f JOIN h USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT th) >= 10 OR count(DISTINCT th) >= 6 AND count(DISTINCT th) > 0.05e0 * docs),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n FROM f JOIN above USING (host, norm) GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.5e0 * n_words AS kept FROM b
"""
