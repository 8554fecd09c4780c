"""From raw documents to packed training sequences: each stage's result is written and read again by the next.

All stages take null ids, null texts (as empty ones), empty tables, repeated rows and further columns of any names. A document
is told by doc_id and text: rows equal in both are judged alike, and only near-dedup leaves one of them. All but the last
stage return the columns of docs in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.llm.common import remove, staged, without
from perfloom.llm.decontamination import contaminated
from perfloom.llm.line_dedup import dedup_lines
from perfloom.llm.packing import pack_documents
from perfloom.llm.quality_classifier import classify
from perfloom.llm.simhash import similar_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Empty texts are judged like others; null labels and labels without a document count for nothing."""
    return without(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not keep"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated windows; n_chars follows the text. A null text stays null; the occurrence in the least doc_id (nulls first) stays."""
    out = dedup_lines(docs).drop("_n_lines", "_n_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word Jaccard similarity of 0.8 or more, found without loss.

    SimHash links what it can reach, verified; such texts differ in up to 11 bits and more, so an exact join adds the rest.
    The document of the least doc_id stays (nulls last; on ties the least text hash). Texts without words are all alike.
    """
    return without(docs, similar_duplicates(docs).where("not stays"), once=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Empty texts and empty items meet nothing."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their ids. An empty text is its end id; equal rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old is not None:
            remove(spark, old._staged_at)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
