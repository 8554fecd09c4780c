"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints that differ in at most tau bits agree, for partitions of the bits with thresholds t_i (-1: not used) that add
up to tau - m + 1, in at least one partition within its threshold. Correlated bits share a partition; cuts and
thresholds come from dynamic programming over estimated costs, the estimate from a bounded sample of fingerprints.
Every distinct fingerprint is probed by all values within t_i of its part. Fingerprints that meet are verified.

A bucket of up to BUCKET fingerprints is verified pair by pair. For a larger one an exact way without pairs takes over:
two fingerprints differ in at most two bits if and only if they share one of the codes that flipping at most one bit of
each gives. All that share a code lie within two bits of each other, and there are at most 65, so linking each with the
least of them loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, scratch, staged
from .similar_texts import similar_texts

TAU, BITS, BUCKET, STEP = 2, 64, 32, 4
#: Fingerprints that the partitions are fitted on.
SAMPLE = 20_000


def fingerprint(body: bytes, n: int = 3) -> int:
    """Bits set in over half the hashes of the n-word shingles, repeats included."""
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    starts, ends = at[: len(words) - n + 1].tolist(), (at[n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], 42) for i, j in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist()))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(codes, pa.int64())], names=["doc_id", "_th", "fp"])


def correlated_order(bits: np.ndarray) -> list[int]:
    """Bits in an order that puts each next to the one it is correlated with most."""
    with np.errstate(invalid="ignore", divide="ignore"):  # a bit that never changes is correlated with none
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T)))
    np.fill_diagonal(c, -1)
    left = set(range(BITS))
    order = [int(c.max(1).argmax())]
    left.discard(order[0])
    while left:
        rest = sorted(left)
        order.append(rest[int(c[order[-1], rest].argmax())])
        left.discard(order[-1])
    return order


def values_within(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def plan_partitions(sample: np.ndarray, total: int) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold) of least estimated cost: values probed, plus pairs that meet, for total fingerprints.

    Partitions are runs of bits in correlated order, cut at multiples of STEP. With thresholds t_i from -1 (not used, free) to
    TAU, the principle asks that all t_i + 1 add up to TAU + 1; how many partitions there are is open. Dynamic programming
    over the end of the last partition and the sum so far finds the cuts and the thresholds together.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    order = correlated_order(bits) if len(sample) > 2 else list(range(BITS))
    n = max(len(sample), 2)
    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for end in range(STEP, BITS + 1, STEP):
        for begin in range(0, end, STEP):
            group = order[begin:end]
            same = np.unique(sample & np.uint64(sum(1 << b for b in group)), return_counts=True)[1].astype(float)
            pairs = float((same * (same - 1) / 2).sum()) / (n * (n - 1) / 2) * total * (total - 1) / 2
            for t in range(-1, TAU + 1):
                # Pairs within t bits are estimated from those that agree, times the values that are probed.
                cost = (total + pairs) * values_within(len(group), t)
                for used in range(TAU + 1 - t):
                    if (begin, used) in best:
                        value, way = best[begin, used]
                        at = (end, used + t + 1)
                        if value + cost < best.get(at, (np.inf, []))[0]:
                            best[at] = (value + cost, [*way, (group, t)])
    return [(group, t) for group, t in best[BITS, TAU + 1][1] if t >= 0]


def probe_masks(parts: list[tuple[list[int], int]]) -> list[tuple[int, int, list[int]]]:
    """(partition, mask, flips): values to probe with are (fp & mask) ^ flip."""
    out = []
    for i, (bits, t) in enumerate(parts):
        flips = [0] + [1 << b for b in bits] * (t >= 1) + [(1 << a) | (1 << b) for k, a in enumerate(bits) for b in bits[:k]] * (t >= 2)
        out.append((i, sum(1 << b for b in bits), flips))
    return out


def long(x: int):
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def links(codes: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) within TAU bits of each other, directly or by others."""
    some = codes.orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    parts = plan_partitions(some, total)
    # The index holds each part as it is; probes are the part with up to t bits flipped, so only one side is expanded.
    index, probes = [], []
    for i, mask, flips in probe_masks(parts):
        value = F.col("fp").bitwiseAND(long(mask))
        index.append(codes.select("fp", F.lit(i).alias("part"), value.alias("value")))
        probes.append(codes.select("fp", F.lit(i).alias("part"), F.explode(F.transform(F.array(*(long(f) for f in flips)), lambda f: value.bitwiseXOR(f))).alias("value")))
    held = index[0]
    for x in index[1:]:
        held = held.union(x)
    asked = probes[0]
    for x in probes[1:]:
        asked = asked.union(x)
    sizes = asked.groupBy("part", "value").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    sizes = staged(sizes, "bucket-sizes")
    large = sizes.where(F.col("w") > BUCKET)
    n = sum(len(f) for _, _, f in probe_masks(parts)) * total
    crowd = attach(asked, large, ["part", "value"], "w", n).select("fp").distinct()
    crowd = staged(crowd, "crowded")
    small = sizes.where(F.col("w") <= BUCKET)
    lone = lambda rows, name: rows.join(small, ["part", "value"], "left_semi").select(F.col("fp").alias(name), "part", "value")
    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    met = lone(held, "a").join(lone(asked, "b"), ["part", "value"]).where((F.col("a") != F.col("b")) & (differ("a", "b") <= TAU)).select("a", "b")
    flips = F.array(*(long(f) for f in [0, *(1 << b for b in range(BITS))]))
    shared = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("code"))
    least = shared.groupBy("code").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    star = least.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return met.union(star)


def similar_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """near_duplicates for texts instead of fingerprints: links are five-word Jaccard similarities of 0.8 or more.

    Close fingerprints (of five-word shingles) are verified first; as most such texts differ in more bits than can be probed,
    an exact join adds all other links. doc_id, _th, component_id and stays as similar_texts gives them.
    """
    return similar_texts(docs, fingerprint, links, text=text, key=key)


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and stays for every row; _th is the text's hash.

    component_id is the smallest doc_id that can be reached over links of at most two differing bits, itself included. stays:
    the row is its component's first by doc_id and _th (rows that agree in both all are). Null and empty texts have fingerprint
    zero and link like any other. Repeated rows each come back; a null doc_id is a component_id only if all of the component
    are null; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.cast("binary").alias("_text"), F.xxhash64(body).alias("_th"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    with scratch(docs.sparkSession) as keep:
        prints = keep(staged(rows.mapInArrow(scan, "doc_id long, _th long, fp long"), "fingerprints"))
        classes = staged(prints.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("uses")), "classes")
        n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.sum("uses")).first()
        found = components(links(classes.select("fp"), n_classes))
        where = classes.join(found.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        where = staged(where, "class-roots")
        tops = where.groupBy("root").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("n"))
        named = keep(staged(attach(where, tops, ["root"], "n", n_classes).select("fp", "uses", "top"), "class-names"))
    out = attach(prints, named, ["fp"], "uses", n_rows or 0)
    return out.select("doc_id", "_th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("top.doc_id").alias("component_id"), (place == F.col("top")).alias("stays"))
