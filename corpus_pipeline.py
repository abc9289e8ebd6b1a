"""The corpus pipeline: five of the training-data operators in a row.

Each stage takes what the stage before it kept, and its decisions take effect: documents without
a recognised language go, of each group of near duplicates the one with the smallest doc_id
stays, documents that hold test items go, personal data is replaced by marks, and the texts that
remain are encoded. All stages but the last return the columns of documents. Rows with a null
doc_id pass the stages that drop by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from octofold.llm import decontaminate, language_id, near_dups, pii_spans, spm_codec
from octofold.llm.common import discard, discard_since, made, small_batches, stored, table

#: Word shingles of five words; a similarity of this many percent or more links.
SIMILAR = 80
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.known_language(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    dropped = near_dups.near_duplicates(docs, SIMILAR).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii_spans.redact(docs, pii_spans.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spm_codec.encode_texts(docs, spm_codec.model_path())


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_leaks),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes from one to the next is written to the shared
    folder, so each stage starts from a table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        known, before, docs = made(), docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
        discard_since(known, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
