"""Corpus preparation in named stages, each a Spark job over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with all their
columns; the last one returns the packed pieces. Labels come from the folder. Every
stage reads whole texts of any length, takes a null text as empty, accepts further
columns of any name (they are kept, or not read), and gives an empty result for an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import exact_dedup as copies
from wakeline.llm import packing, resampling, similarity_join
from wakeline.llm import toxicity as toxic
from wakeline.llm.common import documents, durable, prepare, table

SHINGLE, PERCENT = 5, 80  # of near duplicates


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Rows are judged one by one, so repeated rows and rows without identifier stay or go
    by their own text; an empty text has the intercept's score; without any positive
    training label all stay.
    """
    return toxic.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling doesn't draw go.

    Rows that tie at the last place all stay; of rows that share identifier and text all
    stay if one is drawn; a text without words competes by its noise alone; without any
    label every row stays.
    """
    return resampling.keep_sampled(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the least identifier.

    Null and empty texts are one group; a null identifier comes last; of rows that repeat
    identifier and text one stays.
    """
    prepare(spark)
    return copies.drop_exact_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays, the one with the least identifier.

    Texts without words are linked with nothing and stay; with fewer words than a shingle
    the sequence is the one shingle; rows that share an identifier stay or go together.
    """
    prepare(spark)
    return similarity_join.keep_one_of_each(docs, SHINGLE, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their sequences and offsets.

    A null or empty text is its end id alone; repeated rows are packed each; longer
    documents than a sequence are cut, none is left out.
    """
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity), ("quality_classifier", quality), ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", pack),
]
# Learned stages have no SQL form; the tests hold the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored in the shared folder before the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
