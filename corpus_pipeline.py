"""The corpus pipeline: quality, near-duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. `run` writes each stage's rows as Parquet to the shared folder and reads them for the next.

Defined results: an empty table passes through all stages; null texts are rejected by the first stage; nulls in other columns
are kept; rows that repeat an id and a text are near-duplicates of each other, and one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe_automaton, pii_crf, simhash_tiles, site_quality, source_mix
from girder.llm.common import stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that are toxic or junk go."""
    return site_quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return simhash_tiles.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data is masked in the text, and n_chars follows."""
    masked = pii_crf.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents are drawn, some of them more than once, to their sources' targets."""
    return source_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each row's ids and decoded text, as digests."""
    return bpe_automaton.digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express these stages (fitted models, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
