"""Token counts through a digest cache.

The cache is a folder of Parquet files (digest, tokenizer, n_tokens). A text is looked up by the SHA-256 of its normalised
form (null as empty; nothing else is changed, as the counts of the tokenizer must stay exact) and the digest of the
tokenizer file. Only distinct texts that the cache lacks are encoded, and what they give is appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_dir, staged

MEMO = 400_000
SCHEMA = "digest binary, n_tokens long"
#: The session's setting for the folder of a cache that outlives the call.
CACHE = "spark.perfloom.tokenCache"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def piece_counter(path: str) -> Callable[[str], int]:
    """Counts as sentencepiece's encode gives them.

    Where no piece has a space after another character (checked here), a text is cut before each single space and the counts
    of the parts, which are kept, are added; other texts go to the library whole.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space = "▁"
    apart = all(space not in model.id_to_piece(i).lstrip(space) for i in range(model.get_piece_size()))
    plain = sum(map(len, model.encode(["Ab", "c", "de."]))) == len(model.encode("Ab c de.")) and model.encode("a  b") != model.encode("a b")
    memo: dict[str, int] = {}
    odd = re.compile(f"  |{space}|^ | $|\0")

    def count(text: str) -> int:
        nonlocal memo
        if not text:
            return 0
        if not (apart and plain) or odd.search(text):
            return len(model.encode(text))
        words = text.split(" ")
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            fresh = [w for w in set(words) if w not in memo]
            if len(memo) + len(fresh) > MEMO:
                memo, fresh = {}, list(set(words))
            memo.update(zip(fresh, map(len, model.encode(fresh, num_threads=1)), strict=True))
            return sum(map(memo.__getitem__, words))

    return count


def word_counter(path: str) -> Callable[[str], int]:
    """Counts as tokenizers gives them, special strings as its default."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def counter(path: str) -> Callable[[str], int]:
    return piece_counter(path) if path.endswith(".model") else word_counter(path)


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", *, cache: str | None = None, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    tokenizer: a path, or the name of a public tokenizer file. cache: the cache's folder; None: the one that the session
    names in spark.perfloom.tokenCache, else the tokenizer's own one in the shared folder, so a later call encodes only texts
    that no call before had. Null and empty texts have 0 bytes and 0 tokens; repeated rows each come back; other columns are not read.
    """
    spark = docs.sparkSession
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    version = tokenizer_digest(path)
    cache = cache or spark.conf.get(CACHE, None) or f"{shared_dir(spark)}/perfloom/token-cache/{version}"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("_text"), F.unhex(F.sha2(body, 256)).alias("digest"))
    seen = staged(rows.select("doc_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache)
    # One text of each digest is encoded; equal digests mean equal texts, so any will do. Copies meet map-side first.
    misses = rows.groupBy("digest").agg(F.first("_text").alias("_text"))
    if stored is not None:
        misses = misses.join(stored.where(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())], names=["digest", "n_tokens"])

    fresh = misses.mapInArrow(encode, SCHEMA)
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    total = seen.count()
    uses = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("_uses"))
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).join(uses, "digest")
    out = attach(seen, counts, ["digest"], "_uses", total)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    schema = "digest binary, tokenizer string, n_tokens long"
    there = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(schema).parquet(cache)
