"""The corpus pipeline: language, quality, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The last returns the tokens of
the documents that are left; the others return their input's columns. Null ids, empty texts, repeated rows and empty
tables behave as the operators' docstrings say.
"""

import public_tokenizers

from scholion.llm import bpe, decontam, langid, neardup, quality
from scholion.llm.workspace import table
from pyspark.sql import functions as F


def language(spark, docs, sf_dir):
    """Keeps documents that read like one of the languages learnt from their lang column."""
    return langid.keep(docs)


def good(spark, docs, sf_dir):
    """Keeps documents whose grade is likely to be above the lowest."""
    return quality.keep(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates (five words, similarity 0.8)."""
    return neardup.one_of_each(docs, 5, 80)


def uncontaminated(spark, docs, sf_dir):
    """Keeps documents without a benchmark passage."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids) of each document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("byte_bpe", tokens)]

#: Trained models and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for documents; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
