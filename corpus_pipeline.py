"""A corpus pipeline over ``documents``: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of ``documents``, but for the last, which
returns the packed pieces.  A stage does with nulls, empty and long texts, ties and repeated rows what its operator's
module says; an empty table stays empty, and columns of other names are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import language_id, line_dedup, mixing, ngram_join, packing
from cairnspark.llm.common import only, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter (nulls and empty texts too), and those that are no text of a learned language."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go, a null id before all; documents stay, whatever is left of them."""
    return line_dedup.clean(docs).select(*docs.columns)  # the added columns have other names


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest id stays, null first, and one of equal rows; documents without words all stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets; a repeated document has a row for each time, one without words none."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; repeated documents are packed each on its own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("pattern_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = only(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))  # a stage's scratch tables go once its result is written
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the language models and the fitted packing; tests compare the stages with brute force.
ORACLE_SQL = None
