"""The corpus pipeline: five operators applied one after another to ``documents``.

In every stage, texts are taken whole however long they are, other columns may have any
names, and an empty table gives an empty table. What a stage does with null and empty
texts, null keys and repeated rows is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofly.llm import quality, secrets
from asofly.llm.exact_dedup import drop_copies
from asofly.llm.packing import pack_documents
from asofly.llm.simhash import drop_similar
from asofly.llm.vocab import WORD_BPE, tokenizer_path
from asofly.session import drop_path, scratch_path, scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; every row is judged by its own text."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id.

    Null and empty texts are equal; null keys lose to others; of repeated rows one stays.
    """
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of their five-word shingles of 0.8 or more, the document with the smallest doc_id.

    Texts without a word are one group. Rows that repeat a key are told apart by their
    texts; a null key goes where a row with a key is in its group, and stays otherwise.
    """
    return drop_similar(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds; each row by its own text, whatever its key. Null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: a row for each piece of a document.

    Null and empty texts are one end id; repeated rows and null keys are packed each for itself.
    """
    return pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and token ids can't be expressed in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each stage's result is written and read again, and deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_scope(spark):
            path = scratch_path(spark, f"stage-{name}", keep=True)
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
