"""From raw documents to token ids: quality rules, line and near-duplicate removal, decontamination, BPE.

Each stage takes all that its predecessor kept. Between stages the documents are written as Parquet in the shared folder
and read again, so that no stage is computed twice and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import bpe_roundtrip
from millrace.llm.common import materialize, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.line_dedup import line_dedup
from millrace.llm.quality import keep_good
from millrace.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the fertility bands keep."""
    return keep_good(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source. Copies of a document count as one page."""
    return line_dedup(docs, host="source", distinct=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with near fingerprints or alike sets of five words, the one with the smallest doc_id."""
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    return bpe_roundtrip(docs, ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", site_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("token ids", token_ids),
]

#: Tokens and fingerprints have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
