"""From raw documents to packed sequences: the stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from periodica.llm import langid, line_dedup, mixing, packing, simhash
from periodica.llm.common import table
from periodica.session import materialize


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: without letters, or far from every language of the corpus."""
    return langid.keep_identified(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; n_chars follows the text."""
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked probabilities, so that sources, languages and topics come near tempered shares."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document, tokenised and packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: SQL has no tokenizer and no SimHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
