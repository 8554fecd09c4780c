"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path are like.

A logistic model on hashed words, word beginnings and shape gives each document log odds of being good. Averaged over all
documents of a host, and of a path of that host, its probabilities are soft counts of good documents. A host's share is
shrunk to the whole corpus's, a path's to its host's, each by a prior worth as many documents as the spread tells: the
variance within sites over that between them, both by the method of moments (analysis of variance over all documents). What
the path's share differs from the corpus's, in log odds, is added to the document's evidence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, release, staged

BITS = 17
#: How many documents a prior is worth at most, and at least; and where there is but one site, so that no spread can be seen.
MOST, LEAST, ALONE = 1e6, 1.0, 50.0
#: The model is fitted on at most this many labelled documents (those of the smallest hashes), with their whole texts.
FIT_ROWS = 6_000
SHAPE, CLEAR = 8, 4.5
SCHEMA = "doc_id long, _th long, host string, path string, evidence double"


def slots(word: bytes) -> tuple[int, int, int]:
    """Hashed features of a word: itself, and its first three and five bytes."""
    mask = (1 << BITS) - 1
    return zlib.crc32(word) & mask, zlib.crc32(word[:3], 1) & mask, zlib.crc32(word[:5], 2) & mask


def shape(body: bytes, words: list[bytes]) -> list[float]:
    """Shares that don't depend on length: capitals, digits, symbols, marks, short words, distinct words, repeated lines; and a constant."""
    n, w = max(1, len(body)), max(1, len(words))
    capitals = n - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - len(body.translate(None, b"0123456789"))
    symbols = n - len(body.translate(None, b"#*$%&|<>{}\\^~_=@"))
    marks = n - len(body.translate(None, b"!?"))
    lines = [x for x in body.split(b"\n") if x.strip()]
    return [10 * capitals / n, 10 * digits / n, 20 * symbols / n, 20 * marks / n, sum(len(x) <= 1 for x in words) / w, 2 * len(set(words)) / w, 2 * (1 - len(set(lines)) / max(1, len(lines))), 1.0 if w >= 5 else 0.0]


FEATURES = "id long, th long, good int, slots array<int>, shape array<double>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, text, good to id, th, good, distinct slots, shape."""
    for b in batches:
        found, shapes = [], []
        for t in b.column(2):
            body = t.as_py()
            words = body.lower().split()
            found.append(sorted({s for w in set(words) for s in slots(w)}))
            shapes.append(shape(body, words))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(found, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64()))], names=["id", "th", "good", "slots", "shape"])


def clear(in_good: np.ndarray, in_other: np.ndarray, n_good: int, n_other: int) -> np.ndarray:
    """Slots whose shares in good and in other documents differ by CLEAR standard errors: most words are too rare to tell."""
    p = (in_good + in_other) / (n_good + n_other)
    z = np.abs(in_good / n_good - in_other / n_other) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n_good + 1 / n_other))
    return (z >= CLEAR) & (in_good + in_other >= 3)


def fit(lists: list[list[int]], shapes: np.ndarray, good: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of hashed features, then of the shape, then a bias; logistic loss, each class with half the weight, Adam."""
    size, n = (1 << BITS) + SHAPE + 1, len(good)
    w = np.zeros(size)
    if not n or good.all() or not good.any():
        w[-1] = 0.0 if not n else (4.0 if good.all() else -4.0)
        return w
    many = np.array([len(x) for x in lists])
    row = np.concatenate([np.repeat(np.arange(n), many), np.repeat(np.arange(n), SHAPE + 1)])
    col = np.concatenate([np.array([s for x in lists for s in x], np.int64), np.tile(np.arange(1 << BITS, size), n)])
    val = np.concatenate([np.ones(many.sum()), np.hstack([shapes, np.ones((n, 1))]).ravel()])
    kinds, col = np.unique(col, return_inverse=True)
    x, share = np.zeros(len(kinds)), np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    m, v = np.zeros(len(kinds)), np.zeros(len(kinds))
    for k in range(1, rounds + 1):
        z = np.bincount(row, x[col] * val, n)
        slope = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        g = np.bincount(col, slope[row] * val, len(kinds)) + 1e-4 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
    w[kinds] = x
    return w


def fitted(rows: DataFrame, labels: DataFrame, fit_rows: int) -> np.ndarray:
    """The model, fitted on at most fit_rows labelled documents; to the driver come counts by slot, and of each document the clear slots and the shape."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    pick = marks.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    known = rows.join(F.broadcast(pick), F.col("doc_id") == F.col("_id")).select("doc_id", "_th", "_text", "good").mapInArrow(features, FEATURES)
    known = staged(known.groupBy("id").agg(F.min(F.struct("th", "good", "slots", "shape")).alias("x")).select("id", "x.*"), "fit-features")
    n_good, n_other = (x or 0 for x in known.agg(F.sum("good"), F.sum(1 - F.col("good"))).first())
    each = known.select("id", "good", F.explode("slots").alias("slot"))
    counts = each.groupBy("slot").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b")).toArrow()
    use = np.zeros(1 << BITS, bool)
    if n_good and n_other:
        use[counts["slot"].to_numpy()] = clear(counts["a"].to_numpy(), counts["b"].to_numpy(), n_good, n_other)
    table = rows.sparkSession.createDataFrame([(int(s),) for s in np.flatnonzero(use)], "slot int")
    lists = each.join(F.broadcast(table), "slot").groupBy("id").agg(F.array_sort(F.collect_list("slot")).alias("clear"))
    told = known.select("id", "good", "shape").join(lists, "id", "left").orderBy("id").toArrow()
    w = fit([x or [] for x in told["clear"].to_pylist()], np.array(told["shape"].to_pylist(), float).reshape(-1, SHAPE), told["good"].to_numpy() == 1)
    del told, counts
    release()
    return w


def judge(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        tail = w[1 << BITS :].tolist()
        for b in batches:
            out = []
            for body in b.column(2):
                text = body.as_py()
                words = text.lower().split()
                z = sum(a * x for a, x in zip(tail, [*shape(text, words), 1.0], strict=True))
                kinds = set(words)
                try:
                    z += sum(map(memo.__getitem__, kinds))
                except KeyError:
                    if len(memo) > 300_000:
                        memo.clear()
                    for x in kinds:
                        if x not in memo:
                            memo[x] = float(sum(w[s] for s in slots(x)))
                    z += sum(map(memo.__getitem__, kinds))
                out.append(max(-30.0, min(30.0, z)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(out, pa.float64())], names=["doc_id", "_th", "host", "path", "evidence"])

    return run


def logit(p):
    return F.log(p / (1 - p))


def worth(between: float, within: float, groups: int, size: float) -> float:
    """How many documents a prior is worth: variance within groups over variance between them (mean squares; size: of a typical group)."""
    if groups < 2 or size <= 0:
        return ALONE
    spread = (between - within) / size
    return MOST if spread * MOST <= within else max(LEAST, within / spread)


def prior_worth(sites: DataFrame) -> tuple[float, float]:
    """Of the corpus for its hosts, and of a host for its paths. sites: host, good, square (sums of probabilities and of their squares), n."""
    g2 = F.col("good") * F.col("good") / F.col("n")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum(g2).alias("g2"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"), F.count(F.lit(1)).alias("k"))
    x = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum("g2").alias("path2"), F.sum(g2).alias("host2"), F.sum(F.col("n2") / F.col("n")).alias("n_path"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n_host"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("h")).first()
    if not x.h:
        return ALONE, ALONE
    host = worth((x.host2 - x.good**2 / x.n) / max(1, x.h - 1), (x.square - x.host2) / max(1, x.n - x.h), x.h, (x.n - x.n_host / x.n) / max(1, x.h - 1))
    path = worth((x.path2 - x.host2) / max(1, x.k - x.h), (x.square - x.path2) / max(1, x.n - x.k), x.k - x.h + 1, (x.n - x.n_path) / max(1, x.k - x.h))
    return host, path


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang", cut: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, host, path, evidence, site_prior, posterior and keep (posterior >= cut) for every row; _th is the text's hash.

    labels: doc_id, quality (0 or 1), toxic (0 or 1); good is quality 1 and not toxic, a null label counts as absent. The
    model is fitted on at most fit_rows labelled documents (of rows with one id, the text of the least hash); soft counts
    cover all documents. Without labels the evidence is 0 everywhere and all are kept; with one class only it is +4 or -4.
    Null texts are empty, null hosts and paths are one site; repeated rows each count and come back.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("_th"), body.cast("binary").alias("_text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    weights = spark.sparkContext.broadcast(fitted(rows, labels, fit_rows).astype(np.float32))
    told = staged(rows.mapInArrow(lambda batches: judge(weights.value)(batches), SCHEMA), "evidence")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    sites = staged(told.groupBy("host", "path").agg(F.sum(p).alias("good"), F.sum(p * p).alias("square"), F.count(F.lit(1)).alias("n")), "sites")
    total, good = sites.agg(F.sum("n"), F.sum("good")).first()
    total = total or 0
    overall = ((good or 0.0) + 1.0) / (total + 2.0)
    of_host, of_path = prior_worth(sites)
    hosts = sites.groupBy("host").agg(((F.sum("good") + of_host * overall) / (F.sum("n") + of_host)).alias("_host_share"))
    share = (F.col("good") + F.lit(of_path) * F.col("_host_share")) / (F.col("n") + F.lit(of_path))
    table = sites.join(hosts, "host").select("host", "path", "n", share.alias("site_prior"))
    out = attach(told, table, ["host", "path"], "n", total)
    odds = F.col("evidence") + logit(F.col("site_prior")) - logit(F.lit(overall))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "_th", "host", "path", "evidence", "site_prior", "posterior", (F.col("posterior") >= F.lit(cut) - 1e-12).alias("keep"))
