"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept and returns documents of the same
columns, the last one the packed pieces. Between stages the rows are written as Parquet in
the shared folder, so a lost executor costs no more than its share of one stage.

Empty tables, null texts (empty), null ids and repeated rows pass through as each operator
says. A document that loses its whole text to substring dedup stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclew.llm import packing, private, quality, simhash, substrings
from logclew.llm.queries import vocabulary
from logclew.session import prepare, stage


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the fertility bands go."""
    return quality.keep_good(docs, vocabulary("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return _measured(substrings.remove_repeats(docs), docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(private.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths with their sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", mask_private),
    ("packing", pack),
]

# Fingerprints, tokenisers and contextual rounds have no SQL; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
