"""Fill-in-the-middle documents: texts cut at two units and put together in another order.

Units are runs of ASCII letters and single other characters. While the units of a text are counted, byte and code-point
offsets of every EVERY-th one are noted. A cut is found by a binary search in these checkpoints and a rescan of the units
from there on, so a text is kept as bytes and no list of its units is made.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between checkpoints, and bytes that are scanned at a time.
EVERY, BLOCK = 256, 1 << 16
#: Markers of prefix, suffix and middle; shares, in hundredths, of documents that are changed, and of those in the order suffix, prefix, middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHANGED, SPM = 90, 20
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First bytes of a code point in UTF-8.
LEAD = np.arange(256) & 0xC0 != 0x80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class UnitIndex:
    """The number n of a text's units, and where each of them begins."""

    def __init__(self, body: bytes, every: int = EVERY, block: int = BLOCK):
        self.body = np.frombuffer(body, np.uint8)
        self.n, self.chars = 0, 0
        self.units, self.byte_at, self.char_at = [], [], []
        for first in range(0, len(body), block):
            start, lead = self.starts(first, first + block)
            noted = start[-self.n % every :: every]
            chars = np.cumsum(lead)
            self.units += range(self.n + -self.n % every, self.n + len(start), every)
            self.byte_at += (first + noted).tolist()
            self.char_at += (self.chars + chars[noted] - 1).tolist()
            self.n += len(start)
            self.chars += int(chars[-1])

    def starts(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where units begin among bytes first to last, counted from first, and which of these bytes begin a code point."""
        part = self.body[first:last]
        letter, lead = LETTER[part], LEAD[part]
        new = lead.copy()
        new[1:] &= ~(letter[1:] & letter[:-1])
        if first and letter[0] and LETTER[self.body[first - 1]]:
            new[0] = False
        return np.flatnonzero(new), lead

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of a unit; of unit n, the text's end."""
        if unit >= self.n:
            return len(self.body), self.chars
        k = bisect_right(self.units, unit) - 1
        first, skip = self.byte_at[k], unit - self.units[k]
        if not skip:
            return first, self.char_at[k]
        last = self.byte_at[k + 1] if k + 1 < len(self.units) else len(self.body)
        start, lead = self.starts(first, last)
        return first + int(start[skip]), self.char_at[k] + int(np.count_nonzero(lead[: start[skip]]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that depend on seed and doc_id (a null one counts as an empty string)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(body: bytes, h: list[int], every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of a text and its four numbers."""
    index = UnitIndex(body, every)
    if not body or h[2] % 100 >= CHANGED or any(m in body for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, body
    a, b = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (at, chars), (to, upto) = index.locate(a), index.locate(b)
    prefix, middle, suffix = body[:at], body[at:to], body[to:]
    if h[3] % 100 < SPM:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return index.n, form, chars, upto - chars, b"".join(parts)


def fill_in_middle(docs: DataFrame, *, seed: int = 1, every: int = EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output for every row.

    Texts that are empty (null: empty) or hold a marker stay plain, and so do those that the draw leaves out. Cuts depend on
    seed and doc_id, so equal rows come back alike; a null doc_id draws like an empty string. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [transform(t.as_py(), draws(seed, i), every) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True) if done else [()] * 5
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("t")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marker and none can arise where parts meet, so markers tell where they end."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: DuckDB SQL for the query: units as lists, with the same markers and shares.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS u,
             CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, body, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
