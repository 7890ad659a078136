"""A training-corpus pipeline: quality rules, SimHash near-dedup, substring dedup and best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again for the next stage.
All but the last return the columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessergraph.llm import packing, quality, simhash, substrings
from tessergraph.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go.

    A null or empty text fails the rules; a null host has no verdict; rows that repeat, tie or share an id are judged each
    by itself, whole texts of any length; an empty table stays empty. Other columns are carried through, whatever their names.
    """
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: shingles of five words, similarity 0.8 or more.

    Texts without words are copies of each other. Rows of one id are one document, of which one row stays; rows of no id all
    stay. Texts of any length are compared whole; an empty table stays empty. Other columns are carried through.
    """
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document or place has are cut out.

    Every row stays, a null text as null, and one of nothing but repeats as an empty text. Rows without an id come before
    all others; different texts of one id are told apart, and rows that repeat whole are not each other's copies. An empty
    table stays empty. Other columns are carried through.
    """
    return substrings.cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences of 1024 tokens.

    A null or empty text is the end id alone; rows that repeat, or share an id or have none, are packed each by itself; longer
    documents are cut; an empty table gives no rows. Only doc_id and text are read.
    """
    return packing.pack_documents(docs, *packing.tokenizer_files())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising and fingerprints have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
