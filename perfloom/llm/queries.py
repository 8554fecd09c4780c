"""The thin queries of the contract; each gets its rows through its operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle as fim
from . import line_dedup, ranked_search, url_filters
from . import quality_rules as rules
from .byte_bpe import decode_ids, encode_texts
from .decontamination import contaminated
from .lm_scoring import score_documents
from .packing import pack_documents
from .quality_classifier import classify
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .url_filters import RULES, judge_urls

#: Fixed values of the contract.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_th")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("_th")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("_th", "stays")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("_th", "_gone")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    return out.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(fim.restored(F.col("output"), F.col("form")), 256)).drop("output")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_ids(encode_texts(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_url_filters, op4_lm_scoring, op5_decontamination, op6_quality_classifier, op7_line_dedup, op8_simhash, op9_suffix_dedup, op10_quality_rules, op11_ranked_search, op12_fill_in_middle, op13_byte_bpe)}
ORACLE: dict[str, str] = {"op3_url_filters": url_filters.sql(URL_RULES), "op7_line_dedup": line_dedup.SQL, "op10_quality_rules": rules.SQL, "op11_ranked_search": ranked_search.SQL, "op12_fill_in_middle": fim.SQL}
