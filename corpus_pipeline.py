"""A training corpus from raw documents: five stages, each written before the next.

Every stage but the last gives the columns of documents, others that were there stay.
An empty table stays empty through all stages, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontamination, language, mixing, simhash, tokens
from docspark.llm.queries import MIX_WEIGHTS, mix_levels
from docspark.session import work_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one of little weight, go.

    Null texts and texts without a letter have none. Rows without an id are judged alike, repeated
    rows too, and ties between languages go to the first by name.
    """
    return language.with_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints stays.

    Rows without an id go; of rows that repeat an id one stays, chosen by the hash of its columns.
    """
    return simhash.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go.

    Null and empty texts hold none; without items all stay.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens by target weights; one epoch, so no document comes twice.

    Documents without a word have no token to count and go; null languages and sources are names of
    their own; ties of the seeded order go by id.
    """
    budget = F.expr("total * 9 div 10")
    mixed = mixing.select(docs, mix_levels(), MIX_WEIGHTS, budget, max_epochs=1)
    return mixed.select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32.

    In ascending order of doc_id; a null or empty text is its end id alone.
    """
    return tokens.tokenized(docs)


STAGES = [
    ("language", identify_language),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

# The tokenizer and the fitted language model have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_folder(spark, "llm-pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
