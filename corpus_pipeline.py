"""A corpus pipeline of five stages over `documents`; each stage works on all that the one before it kept.

Language ID drops documents without a language; near-dedup keeps one document
of each group; decontamination drops documents with a benchmark passage; the
secret scan replaces secrets that are no widely copied examples; packing gives
the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, language, packing, secrets, simhash
from marlstone.llm.common import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, p = language.fit(docs)
    return language.identify(docs, names, p, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

#: Tokenising, edit-tolerant linking and model fitting have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, f"stage-{k}")
    return docs
