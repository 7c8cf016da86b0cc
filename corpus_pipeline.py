"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Every stage works on all rows that its predecessor kept, and each result is written as Parquet and read again.

Defined cases: a null text counts as empty: it is never toxic, a copy, contaminated or secret, and packs as its end token;
a null doc_id is kept (as a copy it sorts first); equal rows count once, since copies of a text leave one; further columns
of documents, of any name, pass all stages but the last; empty tables give no rows; without labels or benchmark items
their stages change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, jaccard, packing, queries, secrets, toxicity
from quillstone.runtime import drop_scratch, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id."""
    return jaccard.dedupe(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents covered by benchmark passages go; from others the passages are cut."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs, vocabulary=queries.tokenizer_path())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, mixed by source."""
    return packing.pack(docs, queries.tokenizer_path(), exponent=queries.MIX)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", decontaminate), ("secrets", redact_secrets), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
