"""Packing of token sequences into windows by non-negative least squares over a length histogram.

A document is cut into whole windows and a tail. Tails are counted by length in granules (of GRANULE tokens, rounded up).
All combinations of up to three lengths that fill a window are enumerated, and non-negative least squares finds how often
to use each so that the histogram is used up; counts are rounded. What is left is packed best fit first, longest first.
Windows that would stay emptier than SLACK are given up: their tails are cut at powers of two, and such pieces, longest
first, fill windows without a gap.

Only the histogram (window - 1 counts) and the plan (bounded by the combinations of granules) come to the driver. The n-th
tail of a length takes the n-th place that the plan has for it, and n is a rank within (length, salt) plus counts before
it; a length has one salt for each RANKED of its pieces, so that no task ranks many more than that.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .token_counts import tokenizer_path

WINDOW, GRANULE, SLACK, RANKED = 2048, 8, 40, 4_000
#: Words, and parts of words, that a worker remembers (up to twice as many), and the longest ones in bytes.
MEMO, LONGEST = 300_000, 64
#: Documents whose ids are held at a time.
TAKEN = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>, ids binary, task long, nth long"
#: A piece as placed: how far from the start of what was cut, its length and digest, sequence and slot.
PLACED = pa.struct([(c, pa.int64()) for c in ("shift", "length", "ids_crc32", "sequence_id", "slot")])


def byte_letters() -> dict[int, str]:
    """How byte-level models write bytes: printable ones as they are, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Words of these characters alone need no normaliser but lower-casing: ASCII, and Latin letters that are composed already. Texts may have white space besides.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
PLAIN_TEXT = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017f\x20\x09-\x0d]*")
#: How the split of the word tokenizer reads, for such characters in lower case. No part has white space, so those of a text are those of its words.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\x20\x09-\x0d]+")


class Memo(dict):
    """What make gives for a key. Of two generations the older one goes when the younger one is full, so keys in use stay; long keys are not kept."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        x = self.old.pop(key, None)
        if x is None:
            x = self.make(key)
            if len(key) > LONGEST:
                return x
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = x
        return x


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """Ids (unsigned 32-bit little-endian) of a text as tokenizers gives them without added special tokens.

    For a tokenizer that drops white space, words between ASCII white space are encoded apart and kept: its normaliser and
    its split never look across them. Plain texts and words of the known split go to the tokenizer's model part by part,
    without the costly steps before it, each distinct part once; other words go to the tokenizer as they are. Other tokenizers
    get whole texts. A worker has one encoder, so what is kept serves its next tasks too.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    drops = model.encode("a b", add_special_tokens=False).ids == model.encode("a \n\t b", add_special_tokens=False).ids
    added = spec["added_tokens"]
    apart = drops and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or " " in x["content"] for x in added)
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [x.get("pattern", {}).get("Regex", x["type"]) for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    known = steps == ["NFC", "Replace", "Lowercase"] and split == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel"] and spec.get("post_processor") is None
    special = re.compile("|".join(re.escape(x["content"]) for x in added) or "(?!)")
    letters, bpe = byte_letters(), model.model
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    parts = Memo(lambda p: pack([t.id for t in bpe.tokenize(p.encode().decode("latin-1").translate(letters))]), MEMO)

    by_parts = lambda t: b"".join(map(parts.__getitem__, PARTS.findall(t.lower())))

    def word(w: bytes) -> bytes:
        t = w.decode()
        if known and PLAIN.fullmatch(t) and not special.search(t):
            return by_parts(t)
        return pack(model.encode(t, add_special_tokens=False).ids)

    words = Memo(word, MEMO)

    def encode(body: bytes) -> bytes:
        if not apart:
            return pack(model.encode(body.decode(), add_special_tokens=False).ids)
        if known and PLAIN_TEXT.fullmatch(t := body.decode()) and not special.search(t):
            return by_parts(t)
        return b"".join(map(words.__getitem__, body.split()))

    return encode


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def cut(ids: bytes, window: int) -> list[tuple[int, int, int, list[int]]]:
    """(start, length, crc32, crc32 of the tail's pieces at powers of two) of whole windows and the tail."""
    out, n = [], len(ids) // 4
    for start in range(0, n, window):
        body = ids[4 * start : 4 * (start + window)]
        parts: list[int] = []
        if len(body) < 4 * window:
            at = 0
            for p in powers(len(body) // 4):
                parts.append(zlib.crc32(body[at : at + 4 * p]))
                at += 4 * p
        out.append((start, len(body) // 4, zlib.crc32(body), parts))
    return out


def combinations(size: int) -> list[tuple[int, ...]]:
    """All ways to write size as a sum of up to three positive lengths, each in ascending order."""
    two = [(a, size - a) for a in range(1, size // 2 + 1)]
    three = [(a, b, size - a - b) for a in range(1, size // 3 + 1) for b in range(a, (size - a) // 2 + 1)]
    return [(size,), *two, *three]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |a x - b| with x >= 0, on the normal equations of the columns in use."""
    right = a.T @ b
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a[:, used] @ x[used])
        slope[used] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tol:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            part = a[:, at]
            z = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(at)), right[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = float((x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min())
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]
            if not len(drop):
                drop = at[low][[int(x[at][low].argmin())]]
            x[drop] = 0
            used[drop] = False
            if not used.any():
                break
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) for the lengths that are left: longest first, each into the fullest windows that take it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for s in range(size, 0, -1):
        c = int(left[s])
        while c:
            gap = min((g for g, v in open_.items() if g >= s and v), default=0)
            base, k = open_[gap].pop() if gap else ((), c)
            room = gap or size
            fits = min(room // s, c)
            m = min(k, c // fits)
            if k > m and gap:
                open_[gap].append((base, k - m))
            open_.setdefault(room - fits * s, []).append((base + (s,) * fits, m))
            c -= fits * m
    return [x for v in open_.values() for x in v]


def plan(hist: np.ndarray, window: int = WINDOW, granule: int = GRANULE, slack: int = SLACK) -> dict:
    """Where the tails go. hist[n]: how many tails have n tokens, 0 < n < window.

    seg: rows (granules, first rank, end rank, first sequence, slot), sorted; base[n]: rank of the first tail of n tokens
    among those of as many granules; rest[n]: from which rank on tails of n tokens are cut; first: first sequence of each power's pieces.
    """
    size = window // granule
    bins = -(-np.arange(window) // granule)
    count = np.bincount(bins, hist, size + 1).astype(np.int64)
    base = np.zeros(window, np.int64)
    for n in range(1, window):
        base[n] = base[n - 1] + hist[n - 1] if n > 1 and bins[n] == bins[n - 1] else 0
    made: list[tuple[tuple[int, ...], int]] = []
    if count.sum():
        ways = combinations(size)
        a = np.zeros((size + 1, len(ways)))
        for j, way in enumerate(ways):
            for s in way:
                a[s, j] += 1
        x = nnls(a, count / count.max()) * count.max()
        left = count.copy()
        for j in np.argsort(-x, kind="stable"):
            if (n := int(min([round(x[j]), *(left[s] // ways[j].count(s) for s in ways[j])]))) > 0:
                made.append((ways[j], n))
                for s in ways[j]:
                    left[s] -= n
        made += [(way, n) for way, n in best_fit(left, size) if (size - sum(way)) * granule <= slack]
    taken, sequence, seg = np.zeros(size + 1, np.int64), 0, []
    for way, n in made:
        for slot, s in enumerate(way):
            seg.append((s, int(taken[s]), int(taken[s]) + n, sequence, slot))
            taken[s] += n
        sequence += n
    rest = np.clip(taken[bins] - base, 0, hist)  # tails of a length up to this rank have a place
    before = np.zeros((window, window.bit_length()), np.int64)  # cut tails of smaller lengths that have a piece of 2^k
    n_cut = hist - rest
    for n in range(1, window):
        before[n] = before[n - 1]
        if n > 1:
            for p in powers(n - 1):
                before[n, p.bit_length() - 1] += n_cut[n - 1]
    pieces = np.array([sum(int(n_cut[n]) for n in range(1, window) if n >> k & 1) for k in range(window.bit_length())])
    start = np.zeros(window.bit_length(), np.int64)  # tokens before the first piece of 2^k
    for k in range(window.bit_length() - 2, -1, -1):
        start[k] = start[k + 1] + (pieces[k + 1] << (k + 1))
    total = int((pieces << np.arange(len(pieces))).sum())
    return {"seg": np.array(sorted(seg), np.int64).reshape(-1, 5), "base": base, "bins": bins, "rest": rest, "before": before, "start": start, "total": total, "sequences": sequence}


def place(p: dict, whole: int, window: int) -> Callable:
    """For arrow_udf: length, crc32, crc32 of the parts and rank of tails to arrays of placed pieces, in sequences after the whole ones. The ids themselves don't come here."""

    def run(lengths: pa.Array, digests: pa.Array, parts: pa.Array, ranks: pa.Array) -> pa.Array:
        seg = p["seg"]
        keys = list(map(tuple, seg[:, :2].tolist()))
        blocks = powers(p["total"] % window)
        last = p["total"] - p["total"] % window
        out: list[tuple] = []
        ends = [0]
        for length, crc, own, rank in zip(*(x.to_pylist() for x in (lengths, digests, parts, ranks)), strict=True):
            if rank < p["rest"][length]:
                g, r = int(p["bins"][length]), int(p["base"][length]) + rank
                _, first, _, sequence, slot = seg[bisect.bisect_right(keys, (g, r)) - 1].tolist()
                out.append((0, length, crc, whole + sequence + r - first, slot))
            else:
                at = 0
                for piece, c in zip(powers(length), own, strict=True):
                    k = piece.bit_length() - 1
                    pos = int(p["start"][k]) + (int(p["before"][length, k]) + rank - int(p["rest"][length])) * piece
                    sequence, slot = whole + p["sequences"] + pos // window, pos % window
                    if pos >= last:  # the last window is several, each of a power of two
                        end = 0
                        for i, size in enumerate(blocks):
                            if slot < end + size:
                                sequence += i
                                break
                            end += size
                    out.append((at, piece, c, sequence, slot))
                    at += piece
            ends.append(len(out))
        cols = list(zip(*out, strict=True)) or [()] * len(PLACED)
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(PLACED))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", *, ids: bool = True, end_id: int = 1, window: int = WINDOW, granule: int = GRANULE, slack: int = SLACK, ranked: int = RANKED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids of every piece.

    Each document is its ids followed by end_id; null and empty texts are that id alone. Every id lies in exactly one piece.
    Windows are filled from offset 0 without gaps. ids has the piece's ids, unsigned 32-bit little-endian; with ids=False it
    is left out, and only digests and places are moved. Equal rows are documents of their own; other columns are not read.
    """
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    tail = np.asarray([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_encoder(path), TaskContext.get().partitionId(), 0
        for b in (x.slice(k, TAKEN) for x in batches for k in range(0, max(1, x.num_rows), TAKEN)):
            rows = []
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                line = encode(body.as_py()) + tail
                for x in cut(line, window):
                    rows.append((doc_id, *x[:3], len(line) // 4, x[3], line[4 * x[0] : 4 * (x[0] + x[1])] if ids else None, task, seen))
                    seen += x[1] == window
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "ids", "task", "nth"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    every = staged(rows.mapInArrow(tokenize, PIECES), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for length, n in every.groupBy("length").agg(F.count(F.lit(1))).collect():
        hist[length] = n
    whole, hist[window] = int(hist[window]), 0
    # Whole windows are sequences as they are: numbered in their task, after those of the tasks before (a row a task), and left where they are.
    tasks = every.where(F.col("length") == window).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("_before"))
    full = every.where(F.col("length") == window).join(F.broadcast(tasks), "task")
    full = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    pieces = every.where(F.col("length") < window).drop("task", "nth")
    salts = docs.sparkSession.createDataFrame([(i, -(-int(n) // ranked)) for i, n in enumerate(hist) if n], "length long, _salts long")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_salts"))).drop("_salts")
    groups = staged(pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")  # a row for each RANKED pieces
    earlier = groups.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranks = pieces.withColumn("_rank", F.row_number().over(order)).join(earlier, ["length", "_salt"])
    ranks = ranks.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "ids", (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))
    kind = "array<struct<shift: long, length: long, ids_crc32: long, sequence_id: long, slot: long>>"
    put = F.arrow_udf(place(plan(hist[:window], window, granule, slack), whole, window), kind)
    placed = ranks.select("doc_id", "start", "doc_tokens", "ids", F.explode(put("length", "ids_crc32", "parts", "_rank")).alias("x"))
    own = F.substring("ids", (4 * F.col("x.shift") + 1).cast("int"), (4 * F.col("x.length")).cast("int"))
    placed = placed.select("doc_id", (F.col("start") + F.col("x.shift")).alias("start"), F.col("x.length").alias("length"), F.col("x.ids_crc32").alias("ids_crc32"), "doc_tokens", F.col("x.sequence_id").alias("sequence_id"), F.col("x.slot").alias("slot"), own.alias("ids"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot", "start")) - F.col("length")
    out = full.unionByName(placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), "ids"))
    return out if ids else out.drop("ids")
