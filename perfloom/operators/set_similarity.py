"""Exact similarity join of token sets: prefix rows that carry enough for most candidates to die within the join.

Tokens are told by 64-bit hashes and put in one order for all sets, the rarest first (by counts of 2**20 hash classes, which
come to the driver: any common order is right, a good one is fast). Two sets with a Jaccard similarity of at least t share a
token within their first n - ceil(t * n) + 1 tokens, and the smaller one has it within its first n - ceil(2t / (1 + t) * n) + 1.
A row for each such token carries the set's size, the token's place, a parity bitmap of the set and the tokens just before.
Rows are shuffled once, by token, and sorted by size; a row looks back at the rows of its token that are not too small. A pair
stays if places and bitmaps allow the similarity, and if none of the last tokens before is shared, as the pair has then been
met already. Tokens that very many sets have may fill more than a task should hold: their rows meet in Spark's join, by token
and length bucket. Large inputs go in passes by hash class of the tokens, each of which drops its shuffle files, so what lies
on disk is a pass's rows.

Sets over LONG tokens would have a row for each of very many tokens, and a bitmap too wide to go with each. So pairs whose
larger set is long are tried by bitmaps alone, in blocks by length bucket: the long sets of a bucket are dealt over blocks, the
sets of this and the bucket below go to each. This grows with the square of a bucket's long sets, as rows of their tokens do.
Only pairs that stay are compared as sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import bitmap_of, marked, slimmed

#: Hash classes that tokens are counted by; words of the parity bitmap; how many tokens before a row's own are carried.
CLASSES, WORDS, BEFORE = 1 << 20, 16, 3
#: Tokens of classes that more sets have meet in Spark's join; passes of an input with over MANY tokens; pairs looked at at once.
HOT_SETS, PASSES, MANY, AT_ONCE = 50_000, 4, 1 << 20, 1 << 20
#: Sets of more tokens are tried in blocks of so many sets at least and at most, and as many blocks a bucket as that allows; the widest bitmap.
LONG, BLOCK, MOST_IN_BLOCK, BLOCKS, WIDEST = 512, 4000, 16_000, 16, 1 << 14
EPS = 1e-9
ROWS = "t long, no long, n int, i int, low boolean, bits array<long>, " + ", ".join(f"b{k} long" for k in range(BEFORE))


def hashed(tokens: Column) -> Column:
    """A token array as sorted hashes; equal for equal sets."""
    return F.sort_array(F.transform(tokens, lambda t: F.xxhash64(t)))


def hashed_words(text: Column, stop: list[str]) -> Column:
    """hashed of T.word_tokens, in less time: words are what lies between other characters, and hashes are compared, not words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.sort_array(F.array_except(F.transform(words, lambda t: F.xxhash64(t)), F.array(*(F.xxhash64(F.lit(w)) for w in ["", *stop]))))


def parity(t: np.ndarray, of: np.ndarray, n: int, words: int) -> np.ndarray:
    """A row of bits for each of n sets: whether the number of its tokens t (of set of) in each class is odd."""
    odd = (np.bincount(of * (64 * words) + (t >> 20 & (64 * words - 1)), minlength=n * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, words)


def sketch(x: pa.ListArray, words: int) -> list[pa.Array]:
    """The size of each set of hashes, and the words of its parity bitmap."""
    ends = x.offsets.to_numpy()
    n = np.diff(ends)
    bits = parity(x.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(n)), n), len(n), words)
    return [pa.array(n, pa.int32()), *(pa.array(bits[:, w]) for w in range(words))]


def most_similar(n: tuple[Column, Column], bits: list[tuple[Column, Column]]) -> Column:
    """A bound above the Jaccard similarity of two sets of these sizes and parity bitmaps; 0 where one is empty."""
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits[1:]), F.bit_count(bits[0][0].bitwiseXOR(bits[0][1])))
    both = n[0] + n[1]
    return F.when((n[0] == 0) | (n[1] == 0), F.lit(0.0)).otherwise(F.least((both - apart) / (both + apart), F.least(*n) / F.greatest(*n)))


def rarity(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How frequent tokens of each hash class are, in eighths of powers of two (0: none, 1: one set has it), and the number of all tokens."""
    counts = sets.select(F.explode("x").alias("t")).groupBy((F.col("t").bitwiseAND(CLASSES - 1)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out, n = np.zeros(CLASSES, np.uint8), counts["n"].to_numpy()
    out[counts["c"].to_numpy()] = np.minimum(1 + np.ceil(8 * np.log2(n)), 255)
    return out, int(n.sum())


def prefix_rows(sets: DataFrame, least: float, order: Broadcast, hot: bool = False, turn: int = 0, passes: int = 1) -> DataFrame:
    """ROWS of sets (no, x: sorted hashes) that aren't long, those of the hot or the other tokens, in this of so many passes. low: the token is within the shorter prefix, which does for the smaller set of a pair.

    Tokens whose class only one set has are left out, as nothing can meet there. Where no b tokens are before, there is a
    value that no other set has.
    """
    shorter, top = 2 * least / (1 + least), 1 + 8 * math.log2(HOT_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                x, no = b.column(1)[start : start + 1000], b.column(0)[start : start + 1000].to_numpy()
                ends = x.offsets.to_numpy()
                t, n = x.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)
                if not len(t):
                    continue
                of = np.repeat(np.arange(len(n)), n)
                bits = parity(t, of, len(n), WORDS)
                rank = order.value[t & (CLASSES - 1)]
                at = np.argsort(of << 8 | rank, kind="stable")
                t, rank = t[at], rank[at]
                i = np.arange(len(t)) - np.repeat(ends[:-1] - ends[0], n) + 1
                many, few = (n - np.ceil(w * n - EPS).astype(np.int64) + 1 for w in (least, shorter))
                r = np.flatnonzero((i <= many[of]) & (rank > 1) & ((rank > top) == hot) & (n[of] <= LONG) & ((t >> 40) % passes == turn))
                own, i = of[r], i[r]
                before = [np.where(i > k + 1, t[np.maximum(r - k - 1, 0)], ~no[own]) for k in range(BEFORE)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * WORDS), pa.array(bits[own].ravel()))
                cols = [pa.array(t[r]), pa.array(no[own]), pa.array(n[own].astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(i <= few[own]), lists, *map(pa.array, before)]
                yield pa.RecordBatch.from_arrays(cols, names=["t", "no", "n", "i", "low", "bits", *(f"b{k}" for k in range(BEFORE))])

    return sets.select("no", "x").mapInArrow(run, ROWS)


def look_back(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of ROWS in the order of t, n, no. Only the rows of one Arrow batch and of the token at its end are held."""
    share = least / (1 + least)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        t, no, n, i, low = (rows[c].to_numpy() for c in ("t", "no", "n", "i", "low"))
        bits = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        before = [rows[f"b{k}"].to_numpy() for k in range(BEFORE)]
        group = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]])) << 32
        lows = np.flatnonzero(low)
        first = np.searchsorted(group[lows] + n[lows], group + np.ceil(least * n - EPS).astype(np.int64))
        many = np.maximum(np.cumsum(low) - low - first, 0)
        upto = np.concatenate([[0], np.cumsum(many)])
        start = 0
        while start < len(t):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + AT_ONCE, "right")) - 1)
            p = np.repeat(np.arange(start, end), many[start:end])
            q = lows[first[p] + np.arange(len(p)) + upto[start] - upto[p]]
            start = end
            stays = before[0][p] != before[0][q]
            p, q = p[stays], q[stays]
            both = n[p].astype(np.int64) + n[q]
            stays = np.minimum(n[p] - i[p], n[q] - i[q]) + 1 >= both * share - EPS
            for x in before:
                for y in before:
                    stays &= x[p] != y[q]
            p, q, both = p[stays], q[stays], both[stays]
            apart = np.zeros(len(p), np.int64)
            for w in range(WORDS):
                apart += np.bitwise_count(bits[p, w] ^ bits[q, w])
            stays = apart <= both - 2 * (both * share - EPS)
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(no[p[stays]]), pa.array(no[q[stays]])], names=["a", "b"])

    held = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows:
            t = held["t"].to_numpy()
            cut = len(t) - int(np.argmax(t[::-1] != t[-1])) if t[0] != t[-1] else 0
            yield from pairs(held[:cut]) if cut else ()
            held = held[cut:].combine_chunks()
    if held is not None and held.num_rows:
        yield from pairs(held)


def hot_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) of the ROWS of hot tokens, in Spark's join, which splits what is skewed."""
    bucket = lambda n: F.floor(F.log(n) / F.lit(-math.log(least)) + EPS).cast("int")
    flat = [F.col("bits")[w].alias(f"w{w}") for w in range(WORDS)]
    before = F.array(*(f"b{k}" for k in range(BEFORE))).alias("before")
    one = rows.select("no", "n", "i", "t", before, bucket(F.col("n")).alias("z"), *flat).alias("p")
    # The smaller set is in the same bucket or the one below.
    two = rows.where("low").select("no", "n", "i", "t", before, F.explode(F.array(bucket(F.col("n")), bucket(F.col("n")) + 1)).alias("z"), *flat).alias("q")
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    both = p("n") + q("n")
    shared = both * F.lit(least / (1 + least)) - F.lit(EPS)
    apart = sum((F.bit_count(p(f"w{w}").bitwiseXOR(q(f"w{w}"))) for w in range(1, WORDS)), F.bit_count(p("w0").bitwiseXOR(q("w0"))))
    met = (p("t") == q("t")) & (p("z") == q("z"))
    may = ((p("n") > q("n")) | (p("n") == q("n")) & (p("no") > q("no"))) & (q("n") >= p("n") * F.lit(least) - F.lit(EPS))
    may &= (F.least(p("n") - p("i"), q("n") - q("i")) + 1 >= shared) & (apart <= both - 2 * shared) & ~F.arrays_overlap(p("before"), q("before"))
    return one.join(two, met & may).select(p("no").alias("a"), q("no").alias("b"))


def long_pairs(sets: DataFrame, least: float, parts: int) -> DataFrame | None:
    """(a, b) of the sets (no, x) whose larger one, a, is long; None if there are none."""
    step, share = -math.log(least), least / (1 + least)
    bucket = lambda n: np.floor(np.log(n) / step + EPS).astype(np.int64)
    counts = sets.select(F.size("x").alias("n")).where(F.col("n") > LONG).groupBy(F.floor(F.log("n") / step + EPS).cast("int").alias("z")).count().collect()
    blocks = {r["z"]: math.ceil(r["count"] / min(MOST_IN_BLOCK, max(BLOCK, r["count"] // BLOCKS))) for r in counts}
    if not blocks:
        return None
    first, last = min(blocks) - 1, max(blocks) + 1  # one more on each side, should Spark's logarithm and numpy's differ
    blocks = {z: blocks.get(z, 1) for z in range(first, last + 1)}
    width = {z: min(WIDEST, 1 << math.ceil(math.log2(2.2 * math.exp((z + 1) * step)))) for z in blocks}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, bool, int, int, bytes]] = []
            for no, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = len(x.values)
                if n < least * (LONG + 1) - EPS:
                    continue
                t, own = x.values.to_numpy(), int(bucket(n))
                for z in (own, own + 1):
                    if z in blocks:
                        bits = np.packbits((np.bincount(t >> 20 & (width[z] - 1), minlength=width[z]) & 1).astype(np.uint8)).tobytes()
                        if z == own and n > LONG:
                            out.append((z, (no ^ no >> 33) % blocks[z], False, no, n, bits))
                        out.extend((z, h, True, no, n, bits) for h in range(blocks[z]))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The long sets of a block come first, by size, and are held."""
        now, held, block = None, [], None
        for b in batches:
            z, h, low, no, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cuts = np.flatnonzero((z[1:] != z[:-1]) | (h[1:] != h[:-1]) | (low[1:] != low[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if start == end:
                    continue
                key, part = (z[start], h[start]), (no[start:end], n[start:end].astype(np.int64), np.frombuffer(b"".join(b.column(5)[start:end].to_pylist()), np.uint64).reshape(end - start, -1))
                if key != now:
                    now, held, block = key, [], None
                if not low[start]:
                    held.append(part)
                    continue
                if not held:
                    continue
                block = block or tuple(map(np.concatenate, zip(*held, strict=True)))
                own, sizes, bits = block
                lo, hi = np.searchsorted(sizes, part[1]), np.searchsorted(sizes, part[1] / least + EPS, "right")
                out = []
                for k, (q, m, x) in enumerate(zip(*part, strict=True)):
                    s = slice(lo[k], hi[k])
                    both = sizes[s] + m
                    stays = np.bitwise_count(bits[s] ^ x).sum(1, dtype=np.int64) <= both - 2 * (both * share - EPS)
                    a = own[s][stays & ((sizes[s] > m) | (own[s] > q))]
                    out.append((a, np.full(len(a), q)))
                a, q = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    names = ["z", "h", "low", "no", "n", "bits"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()], strict=True)))
    dealt = sets.select("no", "x").mapInArrow(rows, "z int, h int, low boolean, no long, n int, bits binary").repartition(parts, "z", "h")
    return dealt.sortWithinPartitions("z", "h", "low", "n").mapInArrow(meet, "a long, b long")


def candidate_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of all pairs of sets (no, x: sorted distinct hashes, no two sets alike) with a Jaccard similarity of at least the bound, and few others; b has no more tokens than a. Staged."""
    ranks, tokens = rarity(sets)
    order = sets.sparkSession.sparkContext.broadcast(ranks)
    passes = PASSES if tokens > MANY else 1
    met = []
    for turn in range(passes):
        rows = prefix_rows(sets, least, order, False, turn, passes)
        pairs = rows.repartition("t").sortWithinPartitions("t", "n", "no").mapInArrow(lambda b: look_back(b, least), "a long, b long")
        if ranks.max() > 1 + 8 * math.log2(HOT_SETS):
            pairs = pairs.union(hot_pairs(prefix_rows(sets, least, order, True, turn, passes), least))
        met.append(slimmed(pairs.distinct(), "candidates"))
    out = met[0] if passes == 1 else reduce(DataFrame.union, met).distinct()
    longs = long_pairs(sets, least, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out if longs is None else out.union(slimmed(longs, "long-candidates"))


def those_met(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of sets (no and others) whose number is in pairs (a, b), and few others: told by a bitmap, so nothing is shuffled."""
    bitmap = sets.sparkSession.sparkContext.broadcast(bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("no")).select(F.xxhash64("no").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(marked(bitmap.value, b.column(0).to_numpy()))).select(b.schema.names[1:])

    return sets.select(F.xxhash64("no").alias("_h"), *sets.columns).mapInArrow(run, sets.schema)


def similar_sets(sets: DataFrame, over: float) -> DataFrame:
    """(a, b, similarity) of all pairs of sets (no, x) by number, a < b, whose Jaccard similarity is over the bound. Only sets of candidates are shuffled. Staged."""
    met = candidate_pairs(sets, over)
    x = those_met(sets.select("no", "x"), met)
    p = met.join(x.toDF("a", "xa"), "a").join(x.toDF("b", "xb"), "b")
    p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), T.jaccard(F.col("xa"), F.col("xb")).alias("similarity")).where(F.col("similarity") > over)
    return slimmed(p, "similar-sets")
