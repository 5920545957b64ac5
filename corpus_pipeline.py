"""The training-corpus pipeline: five stages over `documents`, each from Parquet to Parquet.

Toxic documents go, of each group of near-duplicates one document stays, documents with benchmark leaks go,
personal data is masked, and the rest is mixed to the source targets. All stages but the last return the
columns of `documents`; the last returns the mixed corpus: each document with its masked text, the words the mix takes of
it and its place in the schedule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rollscope.llm import decontam, mixing, pii, simhash, toxicity
from rollscope.llm.common import delete_folder, shared_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model trained on `labels` does not predict toxic. Null and empty texts are scored as such."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar by 0.8 or more; texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no item of `benchmark` leaks into. Null and empty texts stay."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts and `n_chars` set anew. Null texts stay null."""
    return pii.mask_personal_data(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, text, size, source_size, target, taken, first_slot, n_slots of all documents, null texts with size 0."""
    return mixing.mix_documents(docs, with_text=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("source_mixing", mixing_stage),
]

#: No SQL: the toxicity and personal-data stages are trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read again.

    A stage's files go as soon as those of the next are written; the last ones are what the result reads.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
            if before:
                delete_folder(spark, before)
            before = f"{folder}/{number}-{name}"
    return docs
