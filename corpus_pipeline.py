"""From raw documents to token files: five stages, each one of the corpus operators.

Every stage takes (session, documents, data folder) and works on all that its predecessor kept. All but the
last return the columns of documents; the last returns what it reads back from the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortspan.llm import decontamination, mixing, simhash, token_files, toxicity
from cohortspan.llm.common import table
from cohortspan.runtime import checkpointed, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on them and ``labels``, does not call toxic."""
    return toxicity.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.distinct_documents(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ``benchmark`` does not contaminate."""
    return decontamination.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row per document in them."""
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("decontamination", without_benchmark),
    ("mixing", mixed), ("tokens", tokens),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer are beyond SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
