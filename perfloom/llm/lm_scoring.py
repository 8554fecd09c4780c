"""Code lengths by prediction by partial matching (PPM) over a byte-context trie.

The model spells a document as its lower-cased words with one space between them, and a last symbol that ends it. A symbol's
contexts are the up to ORDER symbols before it, across words; ahead of the text stand ORDER start marks. Escapes follow
method C (a context's distinct symbols count as escapes), and symbols of a longer context that escaped are excluded in the
shorter ones, exactly: as every symbol of a context also follows its shorter contexts, what is left of a shorter one are
its counts less those of the symbols that the longer one knows. So no symbol sets are needed, only sums.

A node of the trie is a gram: up to ORDER symbols and the symbol behind them, as a number of one byte each. All grams of the
corpus, held-out ones included, are counted, however rare; each level of the trie is the level below without the first
symbol, by grouped sums, and each distinct gram gets its probability by joins between the levels. No group is larger than
the 256 symbols. Documents then add up their grams: those with a fixed least share of all symbols come from a broadcast
table, the others from a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Grams are numbers of ORDER + 1 bytes, so ORDER is at most 6.
ORDER = 5
#: Words with over 1/WORDS of all tokens are broadcast, and grams with over 1/GRAMS of all symbols: at most so many each.
WORDS, GRAMS = 1 << 20, 1 << 23
#: A task passes its counts on when it holds this many; it takes so many bytes of text at a time.
FLUSH, PIECE = 300_000, 1 << 22
#: Symbols that no word holds: the marks ahead of a document, and its end.
START, END = b"\x0b", b"\n"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def pieces(bodies: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of documents, where each starts, grams) of pieces of bounded size; grams behind START stand for no symbol.

    Documents are spelled one after the other; a piece starts with the document that its first gram is of.
    """
    texts, size, first = [], 0, 0
    for i, body in enumerate(bodies):
        texts.append(START * order + b" ".join(body.lower().split()) + END)
        size += len(texts[-1])
        if size >= PIECE or i == len(bodies) - 1:
            a = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            begins = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(a), PIECE):
                hi = min(lo + PIECE, len(a))
                gram = a[lo:hi].astype(np.int64)
                for k in range(1, order + 1):
                    part = a[max(0, lo - k) : hi - k]
                    gram[hi - lo - len(part) :] |= part.astype(np.int64) << (8 * k)
                some = slice(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(begins, hi, "left")))
                yield np.arange(len(texts))[some] + first, np.maximum(begins[some] - lo, 0), gram
            texts, size, first = [], 0, i + 1


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        rows = [(w, n, 0) for w, n in both[0].items()] + [(w, 0, n) for w, n in both[1].items()]
        for c in both:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["word", "train", "other"])

    for b in batches:
        for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c = both[held_out(doc_id)]
            c.update(body.as_py().lower().split())
            c[b""] += 1
            if len(both[0]) + len(both[1]) > FLUSH:
                yield flush()
    yield flush()


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], *(np.add.reduceat(c[by], first) if len(keys) else c for c in counts)


def count_grams(order: int) -> Callable:
    """(doc_id, body) to (gram, n, seen): how often grams are in training documents, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def batch(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=["gram", "n", "seen"])

        for b in batches:
            ids, bodies = b.column(0).to_pylist(), b.column(1)
            for train in (True, False):
                some = [t.as_py() for i, t in zip(ids, bodies, strict=True) if held_out(i) != train]
                for _, _, gram in pieces(some, order):
                    keys, n = np.unique(gram[gram & 255 != START[0]], return_counts=True)
                    held.append((keys, n * train, n))
                    if sum(len(x[0]) for x in held) > 8 * FLUSH:
                        held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                        if len(held[0][0]) > 4 * FLUSH:
                            yield batch(held.pop())
        yield batch(summed(*map(np.concatenate, zip(*held, strict=True))) if held else (none, none, none))

    return run


def gram_scores(counted: DataFrame, order: int) -> DataFrame:
    """counted (gram of order + 1 symbols, n, seen; distinct) with score: log10 of the last symbol's probability behind the others.

    From the shortest contexts up: rest is what a gram adds once its context has escaped, with that context's symbols excluded.
    """
    levels = {order: counted.select("gram", "n")}
    for k in range(order - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        levels[k] = staged(levels[k + 1].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n")), f"grams-{k}")
    total, kinds = levels[0].agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    below = levels[0].select(F.col("gram").alias("low"), F.col("n").alias("low_n"), F.lit(total or 0).alias("low_total"), F.lit(kinds or 0).alias("low_kinds"), F.lit(-math.log10(max(1, 256 - (kinds or 0)))).alias("low_rest"))
    share = lambda a, b: F.log10(a / b.cast("double"))
    for k in range(1, order + 1):
        rows = levels[k].withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(below, "low")
        node = Window.partitionBy(F.shiftright("gram", 8))
        rows = rows.withColumns({"total": F.sum("n").over(node), "kinds": F.count_if(F.col("n") > 0).over(node), "shut": F.sum(F.when(F.col("n") > 0, F.col("low_n")).otherwise(0)).over(node)})
        left, ways = F.col("low_total") - F.col("shut"), F.col("low_kinds") - F.col("kinds")
        rest = F.when(F.col("low_n") > 0, share(F.col("low_n"), left + ways)).otherwise(F.when(left > 0, share(ways, left + ways)).otherwise(0.0) + F.col("low_rest"))
        below = rows.select(F.col("gram").alias("low"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"), F.when(F.col("n") == 0, rest).alias("low_rest"))
    whole = F.col("low_total") + F.col("low_kinds")
    score = F.when(F.col("low_n") > 0, share(F.col("low_n"), whole)).otherwise(F.when(F.col("low_total") > 0, share(F.col("low_kinds"), whole)).otherwise(0.0) + F.col("low_rest"))
    return below.select(F.col("low").alias("gram"), score.alias("score"))


class Table:
    """Whole numbers by whole numbers: open addressing, all at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, 0)  # slot -1 finds a key that is compared, but never right where the slot is empty
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        at, left = self.place(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = free
            left = left[self.slot[at[left]] != left]
            at[left] = at[left] + 1 & len(self.slot) - 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        at = self.place(keys)
        out = self.slot[at]
        left = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        at = at[left]
        while len(left):
            at = at + 1 & len(self.slot) - 1
            out[left] = self.slot[at]
            more = (self.keys[out[left]] != keys[left]) & (out[left] >= 0)
            left, at = left[more], at[more]
        return out


SUMS = "doc_id long, held_out boolean, n_tokens long, _known long, _base double, _score double, _rare array<binary>, _grams array<long>, _row long"


def score_documents(docs: DataFrame, *, order: int = ORDER, words: int = WORDS, grams: int = GRAMS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) for every row.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2. Null texts are empty: one token, their end. A null
    doc_id counts as empty text (it trains). Repeated rows each count and come back. Without training rows every word is
    unknown and each symbol costs log10(256). Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    vocabulary = staged(rows.mapInArrow(count_words, "word binary, train long, other long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("other").alias("other")), "words")
    n_train, n_kinds, n_all = vocabulary.agg(F.sum("train"), F.count_if(F.col("train") > 0), F.sum(F.col("train") + F.col("other"))).first()
    n_train, n_all = n_train or 0, n_all or 0
    scale = math.log10(n_train + n_kinds + 1)
    often = (F.col("train") + F.col("other")) * words > F.lit(n_all)
    table = vocabulary.where(often).select("word", "train").toArrow()
    heavy = spark.sparkContext.broadcast((table["word"].to_pylist(), table["train"].to_numpy()))

    counted = staged(rows.mapInArrow(count_grams(order), "gram long, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), f"grams-{order}")
    n_symbols = counted.agg(F.sum("seen")).first()[0] or 0
    spelled = staged(gram_scores(counted, order).join(counted.select("gram", "seen"), "gram"), "gram-scores")
    many = F.col("seen") * grams > F.lit(n_symbols)
    table = spelled.where(many).select("gram", "score").toArrow()
    heavy_grams = spark.sparkContext.broadcast((table["gram"].to_numpy(), table["score"].to_numpy()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = heavy.value
        index = {w: i for i, w in enumerate(names)}
        # Slot -1 is for words and grams that aren't in the tables; those add nothing here.
        known, base = np.append(counts > 0, 0).astype(float), np.append(np.log10(counts + 1.0) - scale, 0)
        find, model = Table(heavy_grams.value[0]).find, np.append(heavy_grams.value[1], 0)
        for b in batches:
            bodies = [t.as_py() for t in b.column(1)]
            scores, left = np.zeros(len(bodies)), [[] for _ in bodies]
            for own, begin, gram in pieces(bodies, order):
                at = find(gram)
                symbol = gram & 255 != START[0]
                scores[own] += np.add.reduceat(np.where(symbol, model[at], 0.0), begin)
                lost = np.flatnonzero((at < 0) & symbol)
                cut = np.searchsorted(lost, [*begin, len(gram)])
                for i, lo, hi in zip(own.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if hi > lo:
                        left[i].append(gram[lost[lo:hi]])
            out: list[tuple] = []
            for doc_id, body, row, score, rest in zip(b.column(0).to_pylist(), bodies, b.column(2).to_pylist(), scores.tolist(), left, strict=True):
                tokens = body.lower().split()
                tokens.append(b"")
                at = np.array([index.get(t, -1) for t in tokens])
                rare = [tokens[i] for i in np.flatnonzero(at < 0)]
                out.append((doc_id, held_out(doc_id), len(tokens), int(known[at].sum()), float(base[at].sum()), score, rare, np.concatenate(rest) if rest else [], row))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "_known", "_base", "_score", "_rare", "_grams", "_row"])

    sums = staged(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(add_up, SUMS), "lm-sums")
    # Each word and gram here has at most a fixed small share of all, so none makes a large group.
    rest = sums.select("_row", F.explode("_rare").alias("word")).join(vocabulary.where(~often), "word")
    rest = rest.groupBy("_row").agg(F.count_if(F.col("train") > 0).alias("_k"), F.sum(F.log10(F.col("train") + 1.0) - scale).alias("_b"))
    more = sums.select("_row", F.explode("_grams").alias("gram")).join(spelled.where(~many).select("gram", "score"), "gram").groupBy("_row").agg(F.sum("score").alias("_s"))
    out = sums.drop("_rare", "_grams").join(rest, "_row", "left").join(more, "_row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
    return out.select("doc_id", "held_out", "n_tokens", plus("_known", "_k", 0).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), plus("_base", "_b", 0.0).alias("base_score"), plus("_score", "_s", 0.0).alias("score"))
