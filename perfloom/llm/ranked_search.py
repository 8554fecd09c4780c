"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

A shard holds documents of one partition, up to SHARD_BYTES of text. Its postings are one row for each term, so statistics of
terms are read without their postings, and a block of queries reads the postings of its own terms only. In a shard the terms
of a query are ordered by upper bound. Essential lists are added up until what is left could not lift an unseen document
over the least score that still counts; the lists that are left, the non-essential ones, are probed for the documents that
can still qualify, fewer from list to list.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bytes of text and documents in a shard; bytes of queries that are searched (and broadcast) at a time.
SHARD_BYTES, SHARD_DOCS, QUERY_BYTES = 24 << 20, 50_000, 4 << 20
#: One shard in PILOT is searched first: the least scores found there are floors for all shards.
PILOT = 64
#: What is no term: ASCII but digits and letters. A-Z is lower-cased.
LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
#: Fixed values of the score: weights and shares in thousandths, length normalisation in hundredths.
SCALE, B, K1 = 1000, 50, 20
#: A row with a term has its postings (places in the shard, ascending, and occurrences, as unsigned 32-bit integers); one without has the shard's documents: ids, and lengths in column counts.
INDEX = "shard long, term binary, n_docs long, n_terms long, places binary, counts binary, ids array<long>"
FOUND = "item int, doc_id long, score long"


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(LETTERS).split()


class Shard:
    """Documents taken so far."""

    def __init__(self):
        self.code: defaultdict[bytes, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, body: bytes) -> None:
        words = terms_of(body)
        if words:
            bag = Counter(words)
            self.codes.append(np.fromiter(map(self.code.__getitem__, bag), np.int32, len(bag)))
            self.counts.append(np.fromiter(bag.values(), np.uint32, len(bag)))
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.size += len(body)

    def rows(self, number: int) -> pa.RecordBatch:
        """The shard as rows of INDEX, terms in order."""
        terms = sorted(self.code)
        place = np.empty(len(terms), np.int32)
        place[[self.code[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
        code = place[np.concatenate(self.codes)]
        order = np.argsort(code, kind="stable")
        docs = np.repeat(np.arange(len(self.ids), dtype=np.uint32), [len(c) for c in self.codes])[order]
        counts = np.concatenate(self.counts)[order]
        n = np.bincount(code, minlength=len(terms))
        occurrences = np.add.reduceat(counts.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        ends = np.concatenate([[0, 0], np.cumsum(n)]).astype(np.int32) * 4
        head = np.asarray(self.lengths, np.uint32)

        def binary(offsets: np.ndarray, body: bytes) -> pa.Array:
            return pa.BinaryArray.from_buffers(pa.binary(), len(terms) + 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body)])

        shift = np.concatenate([[0], np.full(len(ends) - 1, 4 * len(head))])
        lists = pa.ListArray.from_arrays(pa.array([0, *[len(self.ids)] * (len(terms) + 1)], pa.int32()), pa.array(self.ids, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms) + 1, number)),
                pa.array([None, *terms], pa.binary()),
                pa.array([len(self.ids), *n.tolist()], pa.int64()),
                pa.array([sum(self.lengths), *occurrences.tolist()], pa.int64()),
                binary(ends, docs.tobytes()),
                binary(ends + shift, head.tobytes() + counts.tobytes()),
                lists,
            ],
            names=["shard", "term", "n_docs", "n_terms", "places", "counts", "ids"],
        )


def build_index(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of all rows that have a term, staged: rows of INDEX, those of a shard one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, shard = TaskContext.get().partitionId() << 32, 0, Shard()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(i, t.as_py())
                if shard.size >= shard_bytes or len(shard.ids) >= shard_docs:
                    yield shard.rows(first + done)
                    done, shard = done + 1, Shard()
        if shard.ids:
            yield shard.rows(first + done)

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return staged(docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("t")).mapInArrow(run, INDEX), "search-index")


class Queries:
    """A block of queries: for each the numbers of its terms and their weights."""

    def __init__(self, items: list[bytes], df: dict[bytes, int], n_docs: int, n_terms: int, floors: dict[int, int] | None = None):
        self.n_docs, self.n_terms, self.floors = n_docs, n_terms, floors or {}
        self.number = {t: i for i, t in enumerate(sorted(df))}
        weight = {t: math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        self.items = [sorted((self.number[t], weight[t]) for t in set(terms_of(body)) if t in df) for body in items]

    def impacts(self, lengths: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = 100 - B + B * lengths[places].astype(np.int64) * self.n_docs // self.n_terms
        counts = counts.astype(np.int64)
        return SCALE**3 * counts // (SCALE * counts + K1 * m)


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray, int]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of a shard's documents that score floor or more and can be among its k best, with all equal ones.

    lists: (weight, places, impacts, greatest impact) of each term; size: documents of the shard.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[3])
    rest, least = sum(w * top for w, _, _, top in lists), max(floor, 1)
    score = np.zeros(size, np.int64)
    first = 0
    while first < len(lists) and rest >= least:  # essential: a document not seen yet could qualify
        w, places, impacts, top = lists[first]
        score[places] += w * impacts
        rest -= w * top
        first += 1
        if len(places) >= k:
            least = max(least, int(np.partition(score[places], -k)[-k]))
    held = np.flatnonzero(score + rest >= least)
    mine = score[held]
    for w, places, impacts, top in lists[first:]:  # non-essential: asked for what can qualify
        at = np.minimum(np.searchsorted(places, held), len(places) - 1)
        hit = places[at] == held
        mine[hit] += w * impacts[at[hit]]
        rest -= w * top
        if len(held) > k:
            least = max(least, int(np.partition(mine, -k)[-k]))
        stay = mine + rest >= least
        held, mine = held[stay], mine[stay]
    return held, mine


def best(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score, then least id, null last."""
    return np.lexsort((ids, null, -scores))[:k]


def searcher(queries: Queries, k: int) -> callable:
    """Rows of the index, shard after shard, to the k best documents of all of them for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        number, shard, lengths, ids, null, posts = queries.number, None, None, None, None, {}

        def search() -> None:
            lists = {t: (places, x := queries.impacts(lengths, places, counts), int(x.max())) for t, (places, counts) in posts.items()}
            for q, terms in enumerate(queries.items):
                mine = [(w, *lists[t]) for t, w in terms if t in lists]
                if not mine:
                    continue
                have = tops.get(q)
                floor = max(queries.floors.get(q, 0), int(have[2][-1]) if have and len(have[2]) == k else 0)
                at, scores = max_score(mine, len(lengths), k, floor)
                if len(at):
                    new = ids[at], null[at], scores
                    if have:
                        new = tuple(map(np.concatenate, zip(have, new, strict=True)))
                    keep = best(*new, k)
                    tops[q] = tuple(x[keep] for x in new)

        for b in batches:
            for i in range(b.num_rows):
                if (at := b.column(0)[i].as_py()) != shard:
                    if posts:
                        search()
                    shard, posts = at, {}
                counts = np.frombuffer(b.column(3)[i].as_py(), np.uint32)
                if (term := b.column(1)[i].as_py()) is None:
                    values = b.column(4)[i].values
                    lengths, ids, null = counts, values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
                else:
                    posts[number[term]] = np.frombuffer(b.column(2)[i].as_py(), np.uint32), counts
        if posts:
            search()
        for q, (ids, null, scores) in tops.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=null), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, *, query_bytes: int = QUERY_BYTES, pilot: int = PILOT) -> DataFrame:
    """item_id, text, rank, doc_id and score of the k best documents for each row of items (item_id, text: binary, no two rows alike).

    Queries go in blocks of about query_bytes; each block reads the postings of its own terms once (and those of one shard
    in pilot twice).
    """
    spark = index.sparkSession
    n_docs, n_terms, size = *index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first(), items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // query_bytes) or 1
    out = spark.createDataFrame([], "item_id long, text binary, rank int, doc_id long, score long")
    if not n_docs:
        return out
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        held = [(i, r.item_id, bytes(r.text)) for i, r in enumerate(block.collect())]
        if not held:
            continue
        words = sorted({t for _, _, body in held for t in terms_of(body)})
        vocabulary = F.broadcast(spark.createDataFrame([(t,) for t in [None, *words]], "t binary"))
        own = index.join(vocabulary, F.col("term").eqNullSafe(F.col("t")), "left_semi")
        df = {bytes(r.term): r.n for r in own.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}
        bodies = [body for _, _, body in held]
        rows = own.select("shard", "term", "places", "counts", "ids")

        def run(some: DataFrame, floors: dict[int, int] | None, df=df, bodies=bodies) -> DataFrame:
            queries = spark.sparkContext.broadcast(Queries(bodies, df, n_docs, n_terms, floors))
            # A shard is bounded, and what a partition holds of it comes in one run, its documents first.
            return some.repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(lambda batches: searcher(queries.value, k)(batches), FOUND)

        ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = run(rows.where(F.pmod(F.xxhash64("shard"), F.lit(pilot)) == 0), None)
        floors = {r["item"]: r.score for r in first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).collect()}
        names = F.broadcast(spark.createDataFrame(held, "item int, item_id long, text binary"))
        found = run(rows, floors).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        parts.append(found.join(names, "item").select("item_id", "text", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts, out)


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 50, *, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, text (of the item, binary), rank, doc_id and score: the k documents that score highest for each item.

    Each row of docs with a term is a document, repeated rows too. Null and empty texts have no terms: such documents count
    for nothing, such items find nothing. Equal scores go by ascending doc_id, null last. Items equal in id and text are
    one; an id with several texts has a ranking for each.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    return search(build_index(docs, shard_bytes=shard_bytes, text=text, key=key), items, k, query_bytes=query_bytes)


#: DuckDB SQL for the query: every score of every document with a term of the item.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
l AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM l) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * l.n * s.docs) // s.terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY q.item_id, p.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
