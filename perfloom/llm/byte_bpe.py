"""Byte-level BPE by padded matrices: texts to token ids by a table of ranks, and ids back to bytes.

A text is cut by a pattern; a piece that is itself a token is that token, every other piece is merged on its own. Distinct
pieces that a worker hasn't met lately are put into matrices of token ids, padded to the widths in WIDTHS. In each round
every row merges its leftmost pair of least rank; a merged row loses one column, so the matrix is compacted to one column
less, and rows without a pair that can merge leave it. Ranks of pairs come from a hash table of (left, right).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import tokenizer_path

#: Widths of the matrices in bytes; longer pieces are rows on their own. CELLS bounds a matrix.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
CELLS = 1 << 21
#: A worker remembers the ids of so many pieces of at most LONGEST characters; this many characters are cut at a time.
MEMO, LONGEST, TAKEN = 400_000, 64, 1 << 20
NONE = np.int32(2**31 - 1)
#: Odd multiplier (2**64 over the golden ratio) that spreads pairs over the slots of the hash table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
FREE = np.uint64(2**64 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens: lines of a token in base64, a space and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table with open addressing: (left id, right id) to the id that both merge to, which is the pair's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.merged = np.full(1 << bits, FREE), np.full(1 << bits, NONE)
        key = self.key(left, right)
        slot = self.slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == FREE]
            self.keys[slot[free]] = key[free]  # of pairs with the same slot, the last one gets it
            mine = todo[self.keys[slot[todo]] == key[todo]]
            self.merged[slot[mine]] = merged[mine]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & self.last

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * SPREAD >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for those that don't merge. Ids must not be negative."""
        key = self.key(left, right)
        slot = self.slot(key)
        out = np.full(len(key), NONE)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.merged[slot[todo[hit]]]
            todo = todo[~hit & (there != FREE)]
            slot[todo] = slot[todo] + 1 & self.last
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut = ranks, regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.memo: dict[str, bytes] = {}

    def merged_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to width bytes."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.byte_id[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]
        rank = self.pairs.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(-1, width - 1)
        rank[np.arange(width - 1) >= (n - 1)[:, None]] = NONE
        row = np.arange(len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        while len(row):
            at = rank.argmin(1)  # the first of equal ones
            best = rank[np.arange(len(row)), at]
            live = best != NONE
            for i in np.flatnonzero(~live).tolist():
                out[row[i]] = token[i, : n[i]].astype("<u4").tobytes()
            if not live.all():
                row, n, token, rank, at, best = row[live], n[live], token[live], rank[live], at[live], best[live]
                if not len(row):
                    break
            every, n = np.arange(len(row)), n - 1
            token[every, at] = best
            width = token.shape[1]
            stay = np.ones(token.shape, bool)
            stay[every, at + 1] = False
            token = token[stay].reshape(-1, width - 1)
            if width == 2:
                rank = np.full((len(row), 1), NONE)
                continue
            stay = np.ones(rank.shape, bool)
            stay[every, at] = False
            rank = rank[stay].reshape(-1, width - 2)
            for i, side in ((every[at > 0], at[at > 0] - 1), (every[at < n - 1], at[at < n - 1])):
                rank[i, side] = self.pairs.rank(token[i, side], token[i, side + 1])
        return out

    def merged_long(self, piece: bytes) -> bytes:
        """Ids of one long piece, a row on its own.

        A round merges the leftmost pair of least rank, and goes on to further pairs of that rank from left to right as long
        as no merge makes a pair of lower rank: that is what single merges would do one after the other.
        """
        token = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.rank(token[:-1], token[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping pairs every second one
            left = np.where(np.diff(at, prepend=-3) == 2, best, token[at - 1])
            right = token[np.minimum(at + 2, len(token) - 1)]
            lower = self.pairs.rank(left, np.full(len(at), best)) < best
            lower[0] &= at[0] > 0
            lower |= (self.pairs.rank(np.full(len(at), best), right) < best) & (at + 2 < len(token))
            if lower.any():
                at = at[: lower.argmax() + 1]
            token[at] = best
            token, rank = np.delete(token, at + 1), np.delete(rank, at)
            new = at - np.arange(len(at))
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pairs.rank(token[near], token[near + 1])
        return token.astype("<u4").tobytes()

    def pieces(self, fresh: set[str]) -> dict[str, bytes]:
        """Ids of pieces, whatever their lengths."""
        out: dict[str, bytes] = {}
        shelves: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for p in fresh:
            body = p.encode()
            if (whole := self.ranks.get(body)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(body) > WIDTHS[-1]:
                out[p] = self.merged_long(body)
            else:
                shelves[next(w for w in WIDTHS if w >= len(body))].append((p, body))
        for width, shelf in shelves.items():
            step = CELLS // width
            for i in range(0, len(shelf), step):
                out.update(zip((p for p, _ in shelf[i : i + step]), self.merged_rows([b for _, b in shelf[i : i + step]], width), strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts; a very long one is cut and merged part by part."""
        if len(texts) > 1 or sum(map(len, texts)) <= TAKEN:
            return self.encode_cut([self.cut.findall(t) for t in texts])
        found = (m.group() for m in self.cut.finditer(texts[0]))
        return [b"".join(self.encode_cut([some])[0] for some in iter(lambda: list(islice(found, TAKEN // 4)), []))]

    def encode_cut(self, found: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut already; pieces that are new in any of them are merged together."""
        fresh = {p for f in found for p in f}.difference(self.memo)
        new = self.pieces(fresh)
        if len(self.memo) + len(new) > MEMO:
            self.memo = {p: self.memo[p] for f in found for p in f if p in self.memo}
        self.memo.update(new)
        out = [b"".join(map(self.memo.__getitem__, f)) for f in found]
        for p in new:
            if len(p) > LONGEST:
                del self.memo[p]
        return out


def encode_texts(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, binary) for every row.

    ranks: a path that all machines have, or the name of a public rank file. pattern: what cuts texts into pieces; the
    public files' own by default. A null or empty text has no tokens; a null id stays; repeated rows each come back; texts
    are read whole, and further columns aren't read.
    """
    path = ranks if "/" in ranks else tokenizer_path(ranks)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(path), pattern)
        for b in batches:
            size = b.column(2).to_numpy().cumsum()
            first = 0
            while first < b.num_rows:  # texts of about TAKEN characters together, one at least
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + TAKEN, "right")))
                ids = encoder.encode_all(b.column(1)[first:last].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0)[first:last], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                first = last

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("t"), F.length(body).cast("long").alias("n")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoder(path: str) -> Callable[[bytes], bytes]:
    token = {r: t for t, r in read_ranks(path).items()}
    return lambda ids: b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_ids(rows: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", *, ids: str = "ids") -> DataFrame:
    """rows with column decoded (binary): the bytes of their ids. Null ids give null; an id that the table lacks is an error."""
    path = ranks if "/" in ranks else tokenizer_path(ranks)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder(path)
        for some in batches:
            yield some.map(lambda b: None if b is None else decode(b))

    return rows.withColumn("decoded", decoded(ids))
