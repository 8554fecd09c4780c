"""Near-duplicate texts: all pairs of word-shingle sets with at least a given Jaccard similarity, joined to components.

Links come from SimHash first: fingerprints within the radius of the generalised pigeonhole probing, verified. Texts of such
similarity can differ in many more bits than any radius that can be probed, so an exact join finds the rest, by prefix
filtering: in any one order of all shingles, two sets that are similar enough share one of the first ones of each. The order
puts shingles that a bounded sample of documents holds often at the end; the result doesn't depend on it. Pairs are told
apart cheaply by size and by parity sketches (a bit of such a sketch is the parity of the shingles that hash to it, so two
sets differ in at least as many shingles as their sketches in bits), and verified by the similarity itself.

In a bucket (classes that share a prefix shingle) each class meets the least one first. Buckets that then still hold several
components are compared in blocks of at most BLOCK classes: once for the nearest class by sketch in another component, which
links most of what belongs together, and once for all pairs of different components that pass the sketches. Other pairs
never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap_of, components, keyed, marked, scratch, staged

WORDS, SIMILARITY, BLOCK, TOGETHER = 5, 0.8, 4096, 64
#: Documents that the order of shingles comes from, and the shingles that it puts last: bounds of a broadcast, not of the result.
SAMPLE, OFTEN = 5_000, 100_000
#: The small sketch goes with each row of a bucket, one of MIDDLE bits with those of buckets that are compared in blocks; a
#: wide one, which grows with the set, is looked up for pairs that pass these.
SKETCH, MIDDLE = ["b0", "b1", "b2", "b3"], 1024
#: Of two sets that are similar enough, this share of their sizes' sum differs at most.
DIFFER = (1 - SIMILARITY) / (1 + SIMILARITY)


def shingles(body: bytes, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the n-word shingles, ascending; a shorter text is one shingle, one without words has none."""
    words = body.lower().split()
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    line = b" ".join(words)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(line[i:j]) for i, j in zip(at[: len(words) - n + 1].tolist(), (at[n:] - 1).tolist(), strict=True)], np.uint64))


def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, shingles)."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(shingles(t.as_py()).view(np.int64)) for t in b.column(1)], pa.list_(pa.int64()))], names=["cls", "own"])


def common_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled documents hold, and how many of those do."""
    some = docs.where(F.pmod(F.xxhash64("_id", "_th"), F.lit(max(1, n_docs // SAMPLE))) == 0)
    each = some.select(F.lit(0).cast("long"), "_text").mapInArrow(as_sets, "cls long, own array<long>").select(F.explode("own").alias("h"))
    found = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(OFTEN).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def sketch(own: np.ndarray, bits: int = 256) -> np.ndarray:
    """Parity bits as signed numbers of 64."""
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def width(size: int) -> int:
    """Bits of a wide sketch: a power of two, at least twice the size of the set."""
    return max(MIDDLE, 1 << (2 * size - 1).bit_length())


PRINTS = "_id long, _th long, cls long, size int, prefix array<long>, fp long, middle binary, wide array<long>, b0 long, b1 long, b2 long, b3 long"


def scan(often, fingerprint: Callable[[bytes, int], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses = often.value
        for b in batches:
            cls, size, first, code, bits, middle, wide = [], [], [], [], [], [], []
            for t in b.column(2):
                body = t.as_py()
                own = shingles(body)
                cls.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                size.append(len(own))
                code.append(fingerprint(body, WORDS))
                bits.append(sketch(own))
                middle.append(sketch(own, MIDDLE).tobytes())
                wide.append(sketch(own, width(len(own))))
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    weight = np.where(known[at] == own, uses[at], 0)
                # Of sets of this size two share an element here: similar ones share at least SIMILARITY of the size.
                n = len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1 if len(own) else 0
                first.append(own[np.lexsort((own, weight))[:n]].view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            table = np.array(bits, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(cls), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), signed(code), pa.array(middle, pa.binary()), pa.array(wide, pa.list_(pa.int64())), *(pa.array(table[:, i]) for i in range(4))], names=["_id", "_th", "cls", "size", "prefix", "fp", "middle", "wide", *SKETCH])

    return run


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, own) for each class of the pairs, with the shingles taken from its first document again; other documents' texts stay where they are."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    place = lambda id, th: F.xxhash64(F.coalesce(F.col(id), F.lit(-(1 << 63))), F.col(th))
    of = staged(classes.join(needed, "cls", "left_semi").select(F.col("cls").alias("_cls"), place("first._id", "first._th").alias("h")), "needed-sets")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(of.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from as_sets(iter([b.take(pa.array(marked(bitmap.value, b.column(0).to_numpy())))]))

    sets = docs.select(place("_id", "_th"), "_text").mapInArrow(run, "cls long, own array<long>").join(of, F.col("cls") == F.col("h"))
    out = staged(sets.select(F.col("_cls").alias("cls"), "own").dropDuplicates(["cls"]), "shingle-sets")
    bitmap.destroy()
    return out


def compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows b, salt, a, own, sorted so that the set of b (a is null) comes before those of a: the pairs that are similar enough."""
    end, mine = None, None
    for batch in batches:
        out = []
        for b, salt, a, own in zip(*(batch.column(i) for i in range(4)), strict=True):
            other = own.values.to_numpy()
            if not a.is_valid:
                end, mine = (b.as_py(), salt.as_py()), other
            elif end == (b.as_py(), salt.as_py()):
                at = np.minimum(np.searchsorted(mine, other), max(0, len(mine) - 1))
                shared = int((mine[at] == other).sum()) if len(mine) else 0
                if shared >= SIMILARITY * (len(mine) + len(other) - shared) - 1e-9:
                    out.append((a.as_py(), end[0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough; pairs are staged.

    Wide sketches first; then the set of b goes once to each group of TOGETHER of its pairs, and those of a to their pair.
    """
    wide = classes.select("cls", F.struct("size", "wide").alias("x"))
    uses = pairs.groupBy(F.col("b").alias("cls")).agg(F.count(F.lit(1)).alias("w"))
    held = staged(uses.join(wide, "cls").select(F.col("cls").alias("b"), "w", F.col("x").alias("y")), "pair-ends")
    both = attach(pairs, held, ["b"], "w", pairs.count()).join(wide.withColumnRenamed("cls", "a"), "a")
    # Sets of close sizes have sketches of one width, or one has twice the other's: then its halves are folded together.
    n = F.least(F.size("x.wide"), F.size("y.wide"))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda c: F.when(F.size(c) == n, F.col(c)).otherwise(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), xor))
    apart = F.aggregate(F.zip_with(folded("x.wide"), folded("y.wide"), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda a, b: a + b)
    both = both.where(F.least("x.size", "y.size") >= F.lit(SIMILARITY) * F.greatest("x.size", "y.size") - 1e-9)
    pairs = staged(both.where(apart <= F.lit(DIFFER) * (F.col("x.size") + F.col("y.size")) + 1e-9).select("a", "b", F.ceil(F.col("w") / TOGETHER).cast("int").alias("salts")), "promising-pairs")
    sets = sets_of(docs, classes, pairs)
    ends = pairs.select("b", "salts").distinct().join(sets.toDF("b", "own"), "b")
    ends = ends.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "own")
    rows = ends.union(pairs.join(sets.toDF("a", "own"), "a").select("b", F.pmod(F.hash("a"), F.col("salts")).alias("salt"), "a", "own"))
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return staged(rows.mapInArrow(compare_sets, "a long, b long"), "similar-pairs")


def seeds(docs: DataFrame, classes: DataFrame, close: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs (a, b) that SimHash finds: classes of one fingerprint with the least of them, and least ones of fingerprints that are close."""
    tops = staged(classes.groupBy("fp").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("w")), "fingerprint-tops")
    n_codes, n = tops.agg(F.count(F.lit(1)), F.sum("w")).first()
    same = attach(classes.select("fp", F.col("cls").alias("a")), tops.where("w > 1"), ["fp"], "w", n or 0).where("a <> b").select("a", "b")
    near = close(tops.select("fp"), n_codes)
    top = tops.select("fp", "b")
    near = near.join(top.toDF("a", "x"), "a").join(top.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return verified(staged(same.union(near), "fingerprint-pairs"), docs, classes)


def of_marked(bitmap: np.ndarray) -> Callable:
    """cls, prefix: without the shingles that the bitmap tells are in no other prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            kept = marked(bitmap, flat)
            cut = np.searchsorted(kept, ends).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat[kept]))], names=["cls", "prefix"])

    return run


def near_enough(size: Column, bits: list, size2: Column, bits2: list) -> Column:
    """False only for pairs that can't be similar enough."""
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(bits, bits2, strict=True)), F.lit(0))
    return (F.least(size, size2) >= F.lit(SIMILARITY) * F.greatest(size, size2) - 1e-9) & (apart <= F.lit(DIFFER) * (size + size2) + 1e-9)


def cross_pairs(nearest: bool) -> Callable:
    """Sorted rows h, i, j, block, cls, root, size, middle to pairs of different roots within a bucket's blocks i and j that can be similar enough.

    nearest: for each class outside the largest component only the pair with the least difference of sketches.
    """

    def pairs(x: np.ndarray, bits: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        roots, many = np.unique(x[:, 5], return_counts=True)
        # Pairs within the largest component need no look: of each pair at least one row is of another, and is among the first.
        other = x[:, 5] != roots[many.argmax()]
        one = np.flatnonzero(other)
        for k in range(0, len(one), 64):
            part = one[k : k + 64]
            a, b = x[part][:, None], x[None]
            ok = (a[..., 5] != b[..., 5]) & (np.minimum(a[..., 6], b[..., 6]) >= SIMILARITY * np.maximum(a[..., 6], b[..., 6]) - 1e-9)
            if not same:
                ok &= a[..., 3] != b[..., 3]
            if not nearest:
                ok &= ~other | (x[:, 4] < a[..., 4])
            p, q = np.nonzero(ok)
            u, v, d = [], [], []
            for at in range(0, len(p), 1 << 16):
                m, n = part[p[at : at + (1 << 16)]], q[at : at + (1 << 16)]
                apart = np.bitwise_count(bits[m] ^ bits[n]).sum(1, dtype=np.int32)
                near = apart <= DIFFER * (x[m, 6] + x[n, 6]) + 1e-9
                u, v, d = [*u, m[near]], [*v, n[near]], [*d, apart[near]]
            if not u:
                continue
            u, v, d = np.concatenate(u), np.concatenate(v), np.concatenate(d)
            if nearest:
                by = np.lexsort((x[v, 4], d, u))
                u, v = u[by], v[by]
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else by
                u, v = u[first], v[first]
            if len(u):
                u, v = x[u, 4], x[v, 4]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[:7]], 1) if b.num_rows else np.zeros((0, 7), np.int64)
            bits = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, MIDDLE // 64)
            edge = np.flatnonzero(np.concatenate([[True], (x[1:, :3] != x[:-1, :3]).any(1), [True]])).tolist() if len(x) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                new = tuple(x[lo, :3].tolist())
                if new != key and held:
                    yield from pairs(*map(np.concatenate, zip(*held, strict=True)), key[1] == key[2])
                    held = []
                key = new
                held.append((x[lo:hi], bits[lo:hi]))
        if held:
            yield from pairs(*map(np.concatenate, zip(*held, strict=True)), key[1] == key[2])

    return run


def links(docs: DataFrame, classes: DataFrame, close: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Edges (a, b) that join all classes similar to each other, directly or by others."""
    sure = seeds(docs, classes, close)
    counts = classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    twice = docs.sparkSession.sparkContext.broadcast(bitmap_of(staged(counts, "repeated-shingles").select("h")))
    few = classes.select("cls", "prefix").mapInArrow(lambda batches: of_marked(twice.value)(batches), "cls long, prefix array<long>").where(F.size("prefix") > 0)
    rows = staged(few.join(classes.select("cls", "size", *SKETCH), "cls").select("cls", "size", *SKETCH, F.explode("prefix").alias("h")), "prefix-shingles")
    twice.destroy()
    one = F.struct("cls", "size", *SKETCH)
    buckets = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("w"), F.min(one).alias("least")).where("w > 1"), "shingle-buckets")
    total = rows.count()
    met = staged(attach(rows, buckets, ["h"], "w", total), "bucket-members")

    near = near_enough(F.col("size"), [F.col(c) for c in SKETCH], F.col("least.size"), [F.col(f"least.{c}") for c in SKETCH])
    seen = met.where((F.col("cls") != F.col("least.cls")) & near).select(F.col("cls").alias("a"), F.col("least.cls").alias("b"))
    seen = staged(seen.distinct(), "stars")
    sure = sure.union(verified(staged(seen.join(sure, ["a", "b"], "left_anti"), "new-stars"), docs, classes))
    members = met.where("w > 2").select("h", "cls", "size")  # of two classes the only pair has been looked at
    for nearest in (True, False):
        members = staged(members.join(components(sure).toDF("cls", "root"), "cls", "left").select("h", "cls", "size", F.coalesce("root", "cls").alias("root")), "rooted-members")
        split = members.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "n")
        members = staged(attach(members, staged(split, "split-buckets"), ["h"], "n", total), "split-members")
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        parts = members.withColumn("block", F.pmod(F.hash("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        parts = parts.join(classes.select("cls", "middle"), "cls")
        parts = parts.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "root", F.col("size").cast("long").alias("size"), "middle")
        found = parts.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(cross_pairs(nearest), "a long, b long").distinct()
        found = staged(found.join(seen, ["a", "b"], "left_anti"), "cross-pairs")
        sure, seen, members = sure.union(verified(found, docs, classes)), seen.union(found), members.select("h", "cls", "size")
    return sure


def similar_texts(docs: DataFrame, fingerprint: Callable[[bytes, int], int], close: Callable[[DataFrame, int], DataFrame], *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, _th (the text's hash), component_id and stays for every row.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased) is at least 0.8; texts
    without words are all alike. component_id is the least doc_id that can be reached over links; stays: the row is its
    component's first by doc_id and _th (rows that agree in both all are). Other columns are not read. fingerprint (of a
    text and a shingle length) and close (pairs of close fingerprints) are what SimHash brings.
    """
    rows = keyed(docs, text, key)
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_th")
    with scratch(docs.sparkSession) as keep:
        often = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, docs.count()))
        prints = staged(rows.mapInArrow(scan(often, fingerprint), PRINTS), "shingle-prefixes")
        ends = keep(staged(prints.select("_id", "_th", "cls"), "text-rows"))
        classes = staged(prints.groupBy("cls").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("uses"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), *(F.first(c).alias(c) for c in ("fp", "middle", "wide", *SKETCH))), "text-classes")
        n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.sum("uses")).first()
        where = classes.select("cls", "first", "uses").join(components(links(rows, classes, close)).toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        where = staged(where, "text-roots")
        tops = where.groupBy("root").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("n"))
        named = keep(staged(attach(where, tops, ["root"], "n", n_classes).select("cls", "uses", "top"), "text-names"))
    out = attach(ends, named, ["cls"], "uses", n_rows or 0)
    return out.select(F.col("_id").alias("doc_id"), "_th", F.col("top._id").alias("component_id"), (place == F.col("top")).alias("stays"))
