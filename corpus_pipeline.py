"""A training corpus from documents: five stages, each over all that the one before kept.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8).
3. decontamination: documents that overlap with a benchmark item go.
4. secrets: secrets are replaced by [SECRET]; all documents stay.
5. mixing: sources are mixed to target weights; a row for each document and epoch, with its columns and redacted text.

Each stage keeps all columns of documents, extra ones too, whatever their names; mixing adds n_tokens, epoch, block,
block_key and doc_key (with a `_` at the end where a column of that name is there). In every stage null texts count
as empty, texts of any length are read whole, a null doc_id is told from others by its text, repeated rows share a fate
unless stated, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import decontaminate, jaccard_join, quality_qda, secret_scan, temperature_mix
from veristrata.session import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All labelled rows train; a row is scored by its own text, so equal texts share a fate."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group the smallest doc_id stays, of its equal rows the least by the other columns; rows without words stay, repeated ones too."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows go or stay together; a document without words stays."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text; rows without secrets, null texts among them, are as they were."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is the source ''; a source without words gives nothing. Repeated rows are separate documents; ties do not change what is taken."""
    return temperature_mix.mixture(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: SQL cannot express the quality classifier's fit; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each cut by a checkpoint in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
