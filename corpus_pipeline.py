"""From raw documents to token ids: the operators of `tessera.llm` in a row."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, pii, quality, simhash
from tessera.llm.common import table, work_dir
from tessera.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go.

    A null or empty text, and one under 50 words, is rejected; repeated rows are judged alike; very long texts are read
    whole; even odds are kept; an empty table stays empty; null ids and columns of any name pass through.
    """
    ship(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles, the document with the least id stays.

    Null ids come last, ties go by the hash of the text; of rows that are alike one stays. Null texts and texts without
    words are one group. Very long texts are compared whole; an empty table stays empty; columns of any name pass through.
    """
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts stay, and so do all documents where the benchmark is empty. Very long texts are searched whole;
    repeated rows go or stay together, as it takes no tie to decide; null ids and columns of any name pass through.
    """
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; the number of characters is that of the new text.

    Null texts stay null and have no number of characters; very long texts are searched whole; where findings overlap the
    leftmost counts; repeated rows change alike; an empty table stays empty; other columns of any name pass through.
    """
    ship(spark)
    out = pii.pseudonymised(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids of each document.

    A null text counts as empty and has none; very long texts are encoded whole; ties go as the vocabulary ranks them;
    repeated rows give repeated results; an empty table gives an empty one; null ids stay, other columns are left out.
    """
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Expectation-maximisation, SimHash components and Feistel networks are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
