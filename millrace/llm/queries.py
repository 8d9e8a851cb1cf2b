"""The queries opN_<name> of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_roundtrip
from .common import table
from .decontaminate import SQL as LEAKS_SQL
from .decontaminate import leaks
from .html_extract import extract_text
from .line_dedup import SQL as LINES_SQL
from .line_dedup import line_dedup
from .prefix_join import SQL as JACCARD_SQL
from .prefix_join import ngram_jaccard
from .quality import quality_rules
from .ranked_search import SQL as SEARCH_SQL
from .ranked_search import ranked_search
from .secrets import secret_spans
from .simhash import simhash_groups
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .vafile import SQL as CLUSTER_SQL
from .vafile import cluster_vectors, with_inertia
from .warc import archive_roundtrip


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), report=True)
    return kept.select("doc_id", "n_lines", "n_dropped", "n_chars", F.sha2("text", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_inertia(cluster_vectors(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_extract": op3_html_extract,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_vafile": op12_vafile,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": SEARCH_SQL,
    "op12_vafile": CLUSTER_SQL,
    "op13_ngram_jaccard": JACCARD_SQL,
    "op2_decontaminate": LEAKS_SQL,
    "op7_line_dedup": f"SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars, sha256(text) AS kept_sha256 FROM ({LINES_SQL.format(ratio=0.1, pages=5, docs='documents')})",
}
