"""The queries of this subpackage, by name, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chosen_path, collocations, decontamination, exact_dedup, language_id, licenses, mixing, pii, token_counts, token_output, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents not held out."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b token files of all documents, read back."""
    return token_output.token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of similar documents and their numbers of links."""
    return chosen_path.similar_documents(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of equal texts from Patricia tries."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation; labels stand in for page outcomes by their number."""
    labels = _table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.expr("int(quality = 0 or toxic = 1)").alias("bad"))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), outcomes)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivotal rounding of all documents to their sources' targets."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole texts state or include."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, before and after the three edits of ``sample_edits``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.sample_edits(F.col("text")).alias("edits"))
    return token_counts.count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("leaf_chars", "leaf_tokens")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or with few edits."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 4 words."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by halves, and what they decode to."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_output": op2_token_output,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_byte_bpe": op12_byte_bpe,
}
ORACLE_SQL_BY_NAME: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
}
