"""Removal of repeated byte strings by suffix sorting.

Every position whose next SPAN bytes lie within its document has one anchor: the leftmost of the least-hashed GRAM bytes
in its SPAN bytes. Equal SPAN-byte strings have equal anchors at equal distances, so only positions whose anchors agree
can be equal. Positions in a row that share an anchor are one context: the bytes of all their strings, in two arms, one
from the anchor to the right and one from there to the left. Hashes choose candidates and nothing else: anchors are
counted by hash, and contexts of anchors that occur once are left out (first by a bitmap of fixed size, which may fill up
and then lets more through).

The contexts of an anchor are compared by deep-shallow sorting of both arms: multikey quicksort to a shallow depth, then
blind tries for what still agrees. Of contexts with equal arms the earliest stays, the others are covered. For those that
differ, the orders and the lengths of common prefixes tell for every distance from the anchor which strings are equal: two
strings are if their right arms agree far enough and their left arms do. In each group of equal strings all but the
earliest are covered.

This is done in each map task first, then for all contexts of an anchor. The contexts of a very frequent anchor are dealt
to groups of about GROUP; what each group leaves is dealt anew by the bytes that its strings share (all but BUCKET - 1 of
them), round after round, until groups are small. Nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, keyed, marked, remove, staged

SPAN, GRAM = 100, 24
#: The quicksort takes SYMBOL bytes at a time, and this many in all: a right arm's anchor and two symbols, a left arm's two symbols.
SYMBOL, RIGHT, LEFT = 8, GRAM + 16, 16
#: Contexts that are sorted together; an anchor with more is dealt to several groups if it also has over 1/SHARE of all.
GROUP, SHARE = 2000, 1 << 18
#: Strings of so many distances in a row from an anchor are dealt together by the bytes that all of them have.
BUCKET = 8
#: A document is scanned in parts of this many positions, and parts are taken together up to this many: for bounded memory.
PART = 1 << 18
#: A map task compares its contexts when it holds this many.
HELD = 120_000
#: Where documents without an id stand in the order.
NULL_ID = -(1 << 63)
DISTANCES = SPAN - GRAM + 1


def byte_values() -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([i]), 7) | 1 for i in range(256)], np.uint64)


def powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of documents."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.value = byte_values()
        n = 2 * PART + 2 * SPAN
        self.bits = n.bit_length()
        self.up = powers_of(self.BASE, n)
        self.down = powers_of(pow(self.BASE, -1, 1 << 64), n)

    def hashes(self, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the GRAM bytes at each position: a polynomial by prefix sums, then mixed."""
        n = len(b)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[:n], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def find(self, bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the document, hash of the anchor, first and last start that have it, distance of the first; piece by piece."""
        parts, size = [], 0
        for i, body in enumerate(bodies):
            for lo in range(0, len(body) - SPAN + 1, PART):
                parts.append((i, lo, body if len(body) < PART + SPAN else body[lo : lo + PART + SPAN - 1]))
                size += len(parts[-1][2])
                if size >= PART:
                    yield self.piece(parts)
                    parts, size = [], 0
        if parts:
            yield self.piece(parts)

    def piece(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = self.hashes(np.frombuffer(b"".join(p[2] for p in parts), np.uint8))
        # The low bits give way to the place, so that the least is also the leftmost of those with equal high bits.
        low = np.uint64((1 << self.bits) - 1)
        x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        # Least of each DISTANCES in a row: from blocks of that many, the least up to and from each place.
        starts = len(h) - DISTANCES + 1
        x = np.concatenate([x, np.full(-len(h) % DISTANCES, np.uint64(2**64 - 1))]).reshape(-1, DISTANCES)
        ahead = np.minimum.accumulate(x, 1).ravel()
        back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(back[:starts], ahead[DISTANCES - 1 : DISTANCES - 1 + starts]) & low).astype(np.int64)
        ends = np.cumsum([len(p[2]) for p in parts])
        begins = np.concatenate([[0], ends[:-1]])
        inside = np.ones(starts, bool)
        for e in ends[:-1].tolist():  # strings don't run across documents
            inside[max(0, e - SPAN + 1) : e] = False
        place = np.flatnonzero(inside)
        at = at[place]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)]))
        first, last, at = place[cut], place[np.concatenate([cut[1:], [len(place)]]) - 1], at[cut]
        own = np.searchsorted(begins, first, "right") - 1
        shift = np.array([p[1] for p in parts])[own] - begins[own]
        return np.array([p[0] for p in parts])[own], h[at].view(np.int64), first + shift, last + shift, at - first


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Anchors().find
    for b in batches:
        for _, h, _, _, _ in find([t.as_py() for t in b.column(0)]):
            keys, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["g", "n"])


def agree(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def multikey_quicksort(arms: list[bytes], shallow: int) -> list[list[int]]:
    """Numbers of the arms in order, in groups that agree in the first shallow bytes; a symbol are SYMBOL bytes."""
    out, work = [], [(list(range(len(arms))), 0)]
    while work:
        items, depth = work.pop()
        while len(items) > 1 and depth < shallow:
            symbols = [arms[i][depth : depth + SYMBOL] for i in items]
            pivot = sorted((symbols[0], symbols[len(symbols) // 2], symbols[-1]))[1]
            if symbols.count(pivot) < len(symbols):
                work.append(([i for i, s in zip(items, symbols, strict=True) if s > pivot], depth))
                work.append(([i for i, s in zip(items, symbols, strict=True) if s == pivot], depth + SYMBOL))
                items = [i for i, s in zip(items, symbols, strict=True) if s < pivot]
            else:
                depth += SYMBOL
        if items:
            out.append(items)
    return out


class BlindTrie:
    """Orders arms. Inner nodes keep only the place where their branches part; -1 stands for an arm's end."""

    def __init__(self, arms: list[bytes]):
        self.arms, self.root = arms, None

    def symbol(self, arm: int, at: int) -> int:
        a = self.arms[arm]
        return a[at] if at < len(a) else -1

    def add(self, arm: int) -> None:
        """Goes down blindly to some leaf, compares once with it, and goes in where the two part."""
        if self.root is None:
            self.root = [arm]
            return
        arms, node = self.arms, self.root
        while isinstance(node, tuple):
            at, kids = node
            node = kids.get(self.symbol(arm, at)) or next(iter(kids.values()))
        mine, other = arms[arm], arms[node[0]]
        if mine == other:
            node.append(arm)
            return
        part = agree(mine, other)
        above, edge, below, node = None, 0, node[0], self.root
        while isinstance(node, tuple) and node[0] < part:
            above, edge = node, self.symbol(arm, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == part:
            node[1][self.symbol(arm, part)] = [arm]
            return
        fork = (part, {self.symbol(below, part): node, self.symbol(arm, part): [arm]})
        if above is None:
            self.root = fork
        else:
            above[1][edge] = fork

    def groups(self) -> Iterator[list[int]]:
        """Leaves in order; equal arms share one."""
        work = [self.root]
        while work:
            node = work.pop()
            if isinstance(node, tuple):
                work += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node


def deep_shallow_sort(arms: list[bytes], shallow: int) -> tuple[list[list[int]], list[int]]:
    """Groups of equal arms in order, and how far each agrees with the group before it (the first: -1)."""
    groups: list[list[int]] = []
    for some in multikey_quicksort(arms, shallow):
        if len(some) == 1:
            groups.append(some)
            continue
        trie = BlindTrie(arms)
        for i in some:
            trie.add(i)
        groups.extend(trie.groups())
    return groups, [-1, *(agree(arms[a[0]], arms[b[0]]) for a, b in zip(groups, groups[1:], strict=False))]


def numbers(groups: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, group in enumerate(groups):
        for i in group:
            out[i] = k
    return out


def ids_at(lcp: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for those that agree in depth bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


ROWS = "g long, doc long, th long, lo int, hi int, left int, context binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
NAMES = ["g", "doc", "th", "lo", "hi", "left", "context"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], names=NAMES)


def span_runs(there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true."""
    step = np.diff(np.pad(there, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


class Comparison:
    """Takes the contexts of one anchor after the other; gives runs of covered starts (no context), and what is left of contexts to be compared on."""

    def __init__(self, deal: bool = False):
        self.deal = deal  # what is left goes by the bytes that a bucket's strings share
        self.reset()

    def reset(self) -> None:
        self.out: list[tuple] = []
        self.rows: list[tuple] = []
        self.marks: list[tuple[int, int, int, int, int, bool]] = []  # group; number in the right order, common prefix; the same of the left; is kept
        self.n = 0

    def add(self, g: int, rows: list[tuple], keep: bool) -> None:
        """rows: doc, th, first start, distance of the anchor, context."""
        right, right_lcp = deep_shallow_sort([r[4][r[3] :] for r in rows], RIGHT)
        left, left_lcp = deep_shallow_sort([r[4][: r[3]][::-1] for r in rows], LEFT)
        kinds: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(numbers(right, len(rows)), numbers(left, len(rows)), strict=True)):
            kinds.setdefault(pair, []).append(i)
        self.n += 1
        for (r, l), members in kinds.items():  # noqa: E741
            # Rows with the same place are one document's, read twice; they are one occurrence.
            first = min((rows[i] for i in members), key=lambda x: x[:3])
            self.out += [(x[0] ^ x[2], x[0], x[1], x[2], x[2] + len(x[4]) - SPAN, 0, None) for x in map(rows.__getitem__, members) if x[:3] != first[:3]]
            if keep or len(kinds) > 1:
                self.rows.append((g, *first))
                self.marks.append((self.n, r, right_lcp[r], l, left_lcp[l], keep))

    def flush(self) -> pa.RecordBatch:
        if self.rows:
            self.strings()
        out = batch_of(self.out)
        self.reset()
        return out

    def strings(self) -> None:
        """Of the kinds of contexts, the strings that also start earlier, distance by distance."""
        rows = self.rows
        at, df = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        dl = df - np.array([len(r[5]) for r in rows]) + SPAN
        group, r, r_lcp, l, l_lcp, keep = map(np.array, zip(*self.marks, strict=True))  # noqa: E741
        sides = []
        for number, lcp in ((r, r_lcp), (l, l_lcp)):
            order = np.lexsort((number, group))
            same = np.concatenate([[False], (group[order][1:] == group[order][:-1]) & (number[order][1:] == number[order][:-1])])
            sides.append((np.where(same, 2 * SPAN, lcp[order]), order))
        place = np.lexsort((at, *(np.array([x[k] for x in rows]) for k in (2, 1))))
        covered, valid = np.zeros((len(rows), DISTANCES), bool), np.zeros((len(rows), DISTANCES), bool)
        for d in range(DISTANCES):
            some = place[(dl[place] <= d) & (d <= df[place])]
            key = (ids_at(*sides[0], SPAN - d) * (len(rows) + 1) + ids_at(*sides[1], d))[some]
            first, back = np.unique(key, return_index=True, return_inverse=True)[1:]
            valid[some, DISTANCES - 1 - d] = True  # columns in the order of the starts
            covered[some, DISTANCES - 1 - d] = first[back] != np.arange(len(some))
        zero = at + df - (DISTANCES - 1)
        which, lo, hi = span_runs(covered)
        for k, i, j in zip(which.tolist(), (zero[which] + lo).tolist(), (zero[which] + hi).tolist(), strict=True):
            self.out.append((rows[k][1] ^ i, rows[k][1], rows[k][2], i, j, 0, None))
        left = valid & ~covered & keep[:, None]
        width = BUCKET if self.deal else DISTANCES
        for b in range(0, DISTANCES, width):
            part = left.copy()
            part[:, : max(0, DISTANCES - b - width)] = False
            part[:, DISTANCES - b :] = False
            which, lo, hi = span_runs(part)
            for k, i, j in zip(which.tolist(), (zero[which] + lo).tolist(), (zero[which] + hi).tolist(), strict=True):
                g, doc, th, first, distance, context = rows[k]
                context, distance = context[i - first : j - first + SPAN], distance - (i - first)
                if self.deal:
                    g = xxhash.xxh3_64_intdigest(context[distance - b : distance - b + SPAN - BUCKET + 1], b)
                    g -= g >> 63 << 64
                self.out.append((g, doc, th, i, j, distance, context))


def local(bitmap: np.ndarray) -> Callable:
    """Documents (_id, _th, _text) to rows: the contexts of marked anchors, compared within the task so far as they meet there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, compare = Anchors().find, Comparison()
        held: list[tuple] = []

        def meet() -> Iterator[pa.RecordBatch]:
            nonlocal held
            h = np.array([r[0] for r in held], np.int64)
            by = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1], [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                some = by[lo:hi].tolist()
                for k in range(0, len(some), GROUP):
                    rows = [held[i] for i in some[k : k + GROUP]]
                    if len(rows) > 1:
                        compare.add(rows[0][0], [r[1:] for r in rows], True)
                    else:
                        g, doc, th, at, left, context = rows[0]
                        compare.out.append((g, doc, th, at, at + len(context) - SPAN, left, context))
                if len(compare.out) + len(compare.rows) > 10_000:
                    yield compare.flush()
            yield compare.flush()
            held = []

        for b in batches:
            docs, hashes, bodies = b.column(0).to_pylist(), b.column(1).to_pylist(), [t.as_py() for t in b.column(2)]
            for own, h, first, last, distance in find(bodies):
                k = marked(bitmap, h)
                for i, x, lo, hi, d in zip(own[k].tolist(), h[k].tolist(), first[k].tolist(), last[k].tolist(), distance[k].tolist(), strict=True):
                    held.append((x, docs[i], hashes[i], lo, d, bodies[i][lo : hi + SPAN]))
                if len(held) > HELD:
                    yield from meet()
        if held:
            yield from meet()

    return run


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]] | pa.RecordBatch]:
    """Rows (with a last column salt, sorted by g and salt): those without context as batches, the others as lists of one g and salt."""
    key, held = None, []
    for b in batches:
        there = np.asarray(b.column(6).is_valid())
        if not there.all():
            yield b.filter(pa.array(~there)).select(NAMES)
            b = b.filter(pa.array(there))
        if not b.num_rows:
            continue
        g, salt = b.column(0).to_numpy(), b.column(7).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]), [True]])).tolist()
        rows = list(zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 5, 6)), strict=True))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            new = (int(g[lo]), int(salt[lo]))
            if new != key:
                if held:
                    yield key, held
                key, held = new, []
            held += rows[lo:hi]
    if held:
        yield key, held


def compare_groups(deal: bool) -> Callable:
    """Sorted rows to rows; of groups that were dealt out (salt from 0 on), what is left of the contexts comes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = Comparison(deal)
        for x in groups_of(batches):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            (g, salt), rows = x
            if len(rows) > 1 or salt >= 0:
                compare.add(g, rows, salt >= 0)
            if len(compare.out) + len(compare.rows) > 10_000:
                yield compare.flush()
        yield compare.flush()

    return run


def covered_runs(docs: DataFrame) -> DataFrame:
    """doc, th, lo, hi: the starts lo to hi of a document are those of strings that also start earlier. docs: _id, _th, _text."""
    spark = docs.sparkSession
    counts = docs.select("_text").mapInArrow(count_anchors, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    counts = staged(counts, "repeated-anchors")
    twice = spark.sparkContext.broadcast(bitmap_of(counts.select(F.col("g").alias("h"))))
    rows = docs.mapInArrow(lambda batches: local(twice.value)(batches), ROWS)
    total, deal, spread, covered = counts.agg(F.sum("n")).first()[0] or 0, True, True, None
    while True:
        # At most SHARE groups are dealt out; the salt depends on the place alone, so a task that is run again does the same.
        large = counts.where(F.lit(spread) & (F.col("n") > GROUP) & (F.col("n") * SHARE > F.lit(total))).select("g", F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
        salt = F.coalesce(F.pmod(F.xxhash64("doc", "lo"), F.col("salts")), F.lit(-1)).cast("int")
        sent = rows.join(F.broadcast(large), "g", "left").select(*NAMES, salt.alias("salt"))
        done = staged(sent.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(compare_groups(deal), ROWS), "compared")
        if deal:
            twice.destroy()
        remove(spark, counts._staged_at)
        some = done.where("context is null").select("doc", "th", "lo", "hi")
        covered = some if covered is None else covered.unionByName(some)
        rows = done.where("context is not null")
        counts = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "left-groups")
        left = counts.agg(F.sum("n")).first()[0] or 0
        if not left:
            remove(spark, counts._staged_at)
            return covered
        # Where dealing out no longer helps, groups hold different strings that share most bytes, and are compared whole.
        total, deal, spread = left, False, deal or 2 * left <= total


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their runs of covered starts: doc_id, text, lo, hi to doc_id, n_bytes, n_removed, n_spans, kept."""
    for b in batches:
        out = []
        for doc_id, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            kept, at, spans, gone, end = [], 0, 0, 0, -1
            for i, j in sorted(zip(lo or (), hi or (), strict=True)):
                if i > end:
                    kept.append(text[at:i])
                    spans += 1
                    gone += j + SPAN - i
                else:
                    gone += max(0, j + SPAN - end)
                end = max(end, j + SPAN)
                at = end
            kept.append(text[at:])
            out.append((doc_id, len(text), gone, spans, b"".join(kept)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) for every row.

    Each byte goes that is covered by a SPAN-byte string which also starts earlier: in a smaller doc_id (nulls first), or
    earlier in the same document. Rows that share doc_id but not the text follow the hash of their text; rows that are equal
    in both are one document and come back alike. Texts under SPAN bytes, empty and null ones lose nothing. Runs that touch
    are one span. Other columns are not read.
    """
    mine = keyed(docs, text, key).withColumn("_place", F.coalesce("_id", F.lit(NULL_ID)))
    found = covered_runs(mine.select(F.col("_place").alias("_id"), "_th", "_text")).groupBy("doc", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    both = mine.join(found, (F.col("_place") == F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    return both.select(F.col("_id").alias("doc_id"), "_text", "lo", "hi").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

