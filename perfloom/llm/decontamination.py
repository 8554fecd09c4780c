"""Benchmark decontamination: every passage queries a BM25 index of test items through block-max WAND.

Scores are divided by an item's score for its own words, so one threshold fits items of any length. Items are indexed by
length class, and a class's passages are as long as its items ask for. Before the walk over postings, passages are screened
together: what rare terms give each item is added up, with a bound for the item's frequent terms, which are looked up where
that could do. Only passages with an item that reaches the threshold are walked, so the screen costs what the rare terms'
postings cost, and WAND with its block maxima retrieves from the blocks where there is something to be found.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

K1, B, BLOCK, THRESHOLD, SHINGLE, OVERLAP = 1.2, 0.75, 8, 0.5, 5, 0.8
#: Items are indexed in blocks of about this many bytes, each broadcast; every block is queried by all passages, and scores
#: are those of one index of all items, whatever the blocks.
INDEX_BYTES = 16 << 20
#: Half a passage in words, at least; postings that a screen holds at a time; bytes of documents that are split at a time.
HALF, POSTINGS, TAKEN = 64, 1 << 21, 1 << 20
PUNCTUATION = string.punctuation.encode()
SCHEMA = "doc_id long, _th long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(body: bytes) -> list[bytes]:
    return body.lower().translate(None, PUNCTUATION).split()


def question_and_answer(body: bytes) -> tuple[list[bytes], list[bytes]]:
    """An item's words up to its last line or sentence, and those from there on; halves where there is but one."""
    text = body.strip()
    at = max(text.rfind(b"\n"), text.rfind(b". ", 0, -1), text.rfind(b"? "), text.rfind(b"! "))
    if at > 0:
        return words_of(text[: at + 1]), words_of(text[at + 1 :])
    words = words_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of n words; of a shorter text, of the whole of it."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1))] if words else [], np.uint64))


def half_passage(size: int) -> int:
    """Half the length of passages for an item of so many words: a power of two, no less than the item, so that an item lies within one passage."""
    return max(HALF, 1 << (size - 1).bit_length())


class Index:
    """Postings of impacts (BM25 weight of a term in an item, as a share of the item's own score), items in blocks; all in flat arrays."""

    def __init__(self, items: list[tuple[int, bytes]], corpus: tuple[int, float, dict[bytes, int]] | None = None):
        """corpus: number of items, their mean length and the items that hold each term, where these are more than the given."""
        sized = sorted((n, i, t) for i, t in items if (n := sum(map(len, question_and_answer(t)))))
        self.ids = [i for _, i, _ in sized]
        sizes = np.array([n for n, _, _ in sized], float)
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        terms, counts, own, self.runs = [], [], [], []
        for _, _, t in sized:
            question, answer = question_and_answer(t)
            bag = Counter(question + answer)
            terms.append(np.fromiter(map(code.__getitem__, bag), np.int64, len(bag)))
            counts.append(np.fromiter(bag.values(), np.int64, len(bag)))
            for part in (question, answer, question + answer):
                own.append(shingles(part))
                self.runs.append(min(SHINGLE, len(part)))
        names = sorted(code)
        self.term = {t: i for i, t in enumerate(names)}
        place = np.empty(len(names), np.int64)
        place[[code[t] for t in names]] = np.arange(len(names))
        term = place[np.concatenate(terms)] if terms else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(sized)), [len(x) for x in terms])
        count = np.concatenate(counts) if counts else term
        by = np.lexsort((item, term))
        term, self.item, count = term[by], item[by], count[by].astype(float)
        many, mean, df = corpus or (len(sized), float(sizes.mean()) if len(sized) else 1.0, None)
        held = np.bincount(term, minlength=len(names)) if df is None else np.array([df[t] for t in names], float)
        weight = np.log(1 + (many - held[term] + 0.5) / (held[term] + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[self.item] / mean))
        self.impact = weight / np.bincount(self.item, weight, len(sized))[self.item]
        self.start = np.searchsorted(term, np.arange(len(names) + 1))
        self.top = np.maximum.reduceat(self.impact, self.start[:-1]) if len(names) else self.impact
        self.blocks = len(sized) // BLOCK + 1
        self.block, first = np.unique(term * self.blocks + self.item // BLOCK, return_index=True)
        self.block_top = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.part = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(int)
        self.shingle = np.concatenate(own) if own else np.zeros(0, np.uint64)
        # Frequent terms: the most frequent ones that, together, stay clearly under the threshold in every item.
        self.often = np.zeros(len(sized))
        rare = np.ones(len(names), bool)
        length = np.diff(self.start)
        for t in np.lexsort((np.arange(len(names)), -length)).tolist():
            if length[t] <= 2:
                break
            docs, impact = self.postings(t)
            if (self.often[docs] + impact).max() <= 0.8 * THRESHOLD:
                self.often[docs] += impact
                rare[t] = False
        kept = rare[term]
        by = np.lexsort((term[~kept], self.item[~kept]))  # frequent terms, by item
        self.frequent_term, self.frequent_impact = term[~kept][by], self.impact[~kept][by]
        self.frequent_start = np.searchsorted(self.item[~kept][by], np.arange(len(sized) + 1))
        self.rare_start = np.concatenate([[0], np.cumsum(np.where(rare, length, 0))])
        self.rare_item, self.rare_impact = self.item[kept], self.impact[kept]

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that hold a term, ascending, and their impacts."""
        lo, hi = self.start[t], self.start[t + 1]
        return self.item[lo:hi], self.impact[lo:hi]

    def promising(self, term: np.ndarray, passage: np.ndarray) -> dict[int, list[int]]:
        """Of passages, given as distinct (passage, term) pairs in order, those where some item reaches the threshold, with the blocks of such items.

        Rare terms' postings are added up, with a bound for frequent terms; where that does, the item's frequent terms are
        looked up in the passage. At most POSTINGS postings are held at a time, whatever the passages and items: passages are
        taken in groups, and one that has more by itself adds them up item by item.
        """
        lo, many = self.rare_start[term], self.rare_start[term + 1] - self.rare_start[term]
        edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1], [True]]))
        upto = np.concatenate([[0], np.cumsum(many)])
        pair = passage * len(self.term) + term
        out: dict[int, list[int]] = {}
        k = 0
        while k < len(edge) - 1:
            a = edge[k]
            k = max(k + 1, int(np.searchsorted(upto[edge], upto[a] + POSTINGS, "right")) - 1)
            b = edge[k]
            if upto[b] - upto[a] <= POSTINGS:
                at = self.spread(lo[a:b], many[a:b])
                cell, back = np.unique(np.repeat(passage[a:b], many[a:b]) * len(self.ids) + self.rare_item[at], return_inverse=True)
                where, item = np.divmod(cell, len(self.ids))
                score = np.bincount(back, self.rare_impact[at], len(cell))
            else:
                score = np.zeros(len(self.ids))
                for i in range(a, b):
                    for j in range(lo[i], lo[i] + many[i], POSTINGS):
                        part = slice(j, min(j + POSTINGS, lo[i] + many[i]))
                        score[self.rare_item[part]] += self.rare_impact[part]
                item = np.arange(len(self.ids))
                where = np.full(len(item), passage[a])
            may = score + self.often[item] >= THRESHOLD - 1e-9
            for q, block in self.reaching(where[may], item[may], score[may], pair):
                out.setdefault(q, []).append(block)
        return out

    def reaching(self, passage: np.ndarray, item: np.ndarray, score: np.ndarray, pair: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block), in order, with an item whose score, with the frequent terms that both hold, reaches the threshold."""
        many = np.diff(self.frequent_start)[item]
        upto = np.cumsum(many)
        good: list[np.ndarray] = []
        first = 0
        while first < len(item):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + POSTINGS, "right")))
            n = many[first:last]
            at = self.spread(self.frequent_start[item[first:last]], n)
            key = np.repeat(passage[first:last], n) * len(self.term) + self.frequent_term[at]
            held = pair[np.minimum(np.searchsorted(pair, key), len(pair) - 1)] == key
            whole = score[first:last] + np.bincount(np.repeat(np.arange(last - first), n), self.frequent_impact[at] * held, last - first)
            enough = whole >= THRESHOLD - 1e-9
            good.append(passage[first:last][enough] * self.blocks + item[first:last][enough] // BLOCK)
            first = last
        return [divmod(x, self.blocks) for x in np.unique(np.concatenate(good)).tolist()] if good else []

    @staticmethod
    def spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
        """All places of runs that begin at lo and are so long."""
        return np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())

    def block_bound(self, t: int, block: int) -> float:
        key = t * self.blocks + block
        at = np.searchsorted(self.block, key)
        return float(self.block_top[at]) if at < len(self.block) and self.block[at] == key else 0.0

    def walk(self, terms: np.ndarray, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least THRESHOLD, in all blocks or in the given ones, by WAND with block maxima."""
        if blocks is not None:
            found = []
            for block in blocks:  # of each list the postings within the block
                lists = []
                for t in terms.tolist():
                    docs = self.item[self.start[t] : self.start[t + 1]]
                    lo, hi = (np.searchsorted(docs, (block * BLOCK, (block + 1) * BLOCK)) + self.start[t]).tolist()
                    if lo < hi:
                        lists.append([lo, hi, t])
                found += self.wand(lists)
            return found
        return self.wand([[int(self.start[t]), int(self.start[t + 1]), int(t)] for t in terms])

    def wand(self, lists: list[list[int]]) -> list[tuple[int, float]]:
        """lists: [place in the postings, their end, term]."""
        docs = self.item
        found, enough = [], THRESHOLD - 1e-9
        while lists:
            lists.sort(key=lambda x: docs[x[0]])
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= enough:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = docs[lists[pivot][0]]
            while pivot + 1 < len(lists) and docs[lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_bound(t, block) for _, _, t in lists[: pivot + 1]) < enough:
                # No item up to the block's end, or to the next list's item, can do: go there.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, docs[lists[pivot + 1][0]])
            elif docs[lists[0][0]] == item:
                score = sum(float(self.impact[p]) for p, _, _ in lists[: pivot + 1])
                if score >= enough:
                    found.append((int(item), score))
                to = item + 1
            else:
                to = item
            for x in lists[: pivot + 1]:
                if docs[x[0]] < to:
                    x[0] += int(np.searchsorted(docs[x[0] : x[1]], to))
            lists = [x for x in lists if x[0] < x[1]]
        return found

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's question, answer and whole shingles that the words hold."""
        have: dict[int, np.ndarray] = {}

        def share(k: int) -> float:
            part, n = self.shingle[self.part[k] : self.part[k + 1]], self.runs[k]
            if not len(part):
                return 1.0
            if n not in have:
                have[n] = shingles(words, n)
            return len(np.intersect1d(part, have[n], assume_unique=True)) / len(part)

        return share(3 * item), share(3 * item + 1), share(3 * item + 2)


def indexes(items: list[tuple[int, bytes]], corpus: tuple[int, float, dict[bytes, int]]) -> list[tuple[int, Index]]:
    """An index for each length class of the items, with half its passages' length."""
    classes: defaultdict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for i, t in items:
        if n := sum(map(len, question_and_answer(t))):
            classes[half_passage(n)].append((i, t))
    return [(half, Index(some, corpus)) for half, some in sorted(classes.items())]


def corpus_of(items: list[tuple[int, bytes]]) -> tuple[int, float, dict[bytes, int]]:
    """What scores need of all items: how many have words, their mean length, and how many hold each term."""
    many, words, df = 0, 0, Counter()
    for _, t in items:
        question, answer = question_and_answer(t)
        if question or answer:
            many, words = many + 1, words + len(question) + len(answer)
            df.update({*question, *answer})
    return many, words / max(1, many), df


def hits(bodies: list[list[bytes]], half: int, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """(body, item, score, question and answer overlap) of all passages of bodies that hold an item; passages of 2 * half words overlap by half."""
    place: list[tuple[int, int]] = []
    pairs = []
    get = index.term.get
    for k, words in enumerate(bodies):
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(code >= 0)
        part, code = at // half, code[at]
        count = max(1, -(-len(words) // half) - 1)
        base = len(place)
        place += [(k, j) for j in range(count)]
        for shift in (0, 1):
            p = part - shift
            ok = (p >= 0) & (p < count)
            pairs.append((base + p[ok]) * len(index.term) + code[ok])
    pair = np.unique(np.concatenate(pairs))
    if not len(pair):
        return
    passage, term = np.divmod(pair, len(index.term))
    for q, blocks in index.promising(term, passage).items():
        lo, hi = np.searchsorted(passage, [q, q + 1])
        k, j = place[q]
        for item, score in index.walk(term[lo:hi], blocks):
            question, answer, whole = index.verify(item, bodies[k][j * half : (j + 2) * half])
            if min(question, answer, whole) >= OVERLAP:
                yield k, item, score, question, answer


def scan(held: list[tuple[int, Index]]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "_th", "item_id", "score", "question_overlap", "answer_overlap"], [pa.int64()] * 3 + [pa.float64()] * 3
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            size = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in b.column(2)])
            best: dict[tuple, tuple] = {}
            first = 0
            while first < b.num_rows:  # documents of about TAKEN bytes together, one at least
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + TAKEN, "right")))
                bodies = [words_of(t.as_py()) for t in b.column(2)[first:last]]
                for half, index in held:
                    for k, item, score, question, answer in hits(bodies, half, index):
                        row = (ids[first + k], hashes[first + k], index.ids[item], score, question, answer)
                        best[first + k, half, item] = max(best.get((first + k, half, item), row), row, key=lambda r: r[3])
                first = last
            cols = list(zip(*best.values(), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to (term, n): each distinct word once; the number of all words stands behind a null term."""
    for b in batches:
        bags = [[w for part in question_and_answer(t.as_py()) for w in part] for t in b.column(0)]
        terms = [(t, 1) for bag in bags for t in set(bag)] + [(None, len(bag)) for bag in bags if bag]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.binary()), pa.array([n for _, n in terms], pa.int64())], names=["term", "n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap for each row of docs that holds an item; _th is the text's hash.

    Words are lower-cased and freed from punctuation. Passages are twice as long as the item's length class (the next power of
    two of its words, 64 at least) and overlap by half. A hit scores at least THRESHOLD of the item's own BM25 score and holds at least OVERLAP of the
    five-word shingles of its question, of its answer and of both together. An item of fewer words must stand there whole.
    Null or empty texts and items hit nothing. Items are taken in blocks of bounded size, one broadcast each; term
    statistics are those of all items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-size // index_bytes) or 1
    whole = None
    if n > 1:
        terms = staged(items.select("t").mapInArrow(term_counts, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "benchmark-terms")
        whole = terms.where("term is null").first()
    out = None
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        held = [(r.i, bytes(r.t)) for r in some.collect()]
        if whole:
            own = some.select("t").mapInArrow(term_counts, "term binary, n long").select("term").distinct()
            corpus = (whole.rows, whole.n / whole.rows, {bytes(r.term): r.n for r in terms.join(own, "term").collect()})
        else:
            corpus = corpus_of(held)
        block = spark.sparkContext.broadcast(indexes(held, corpus))
        part = rows.mapInArrow(lambda batches, block=block: scan(block.value)(batches), SCHEMA)
        out = part if out is None else out.union(part)
    return out
