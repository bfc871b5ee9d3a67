"""A training-data pipeline over `documents`: filter, deduplicate, decontaminate, mask, pack.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last
return the columns of docs. run() writes each stage's rows to the shared folder and reads
them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import contamination, packing, personal_data, quality, simhash
from ticketloom.llm.common import table
from ticketloom.llm.queries import tokenizer_file
from ticketloom.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and hold enough content lines."""
    return quality.kept_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.one_per_group(docs, shingle=3, radius=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars follows the text."""
    rows = personal_data.masked_rows(docs)
    return rows.withColumn("n_chars", F.coalesce(F.char_length("text").cast(
        rows.schema["n_chars"].dataType), "n_chars")) if "n_chars" in rows.columns else rows


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data_masking),
    ("best-fit packing", best_fit_packing),
]
#: SQL has neither the line model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
