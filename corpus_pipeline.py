"""Corpus pipeline: quality filter, exact and near de-duplication, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. No SQL expresses the scorer and MinHash stages, so
the whole is tested against a brute-force version (``tests/llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import exact_dedup, mixing, near_dups, pieces, quality
from quantloom.llm.common import ready_for_texts, stage, table
from quantloom.llm.queries import PIECE_MODEL
from quantloom.session import only_result_stays, unstage

ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer does not reject."""
    ready_for_texts(spark)
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    ready_for_texts(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word similarity of 0.8 the one with the smallest doc_id."""
    ready_for_texts(spark)
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut at its budget."""
    ready_for_texts(spark)
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the text's piece ids."""
    ready_for_texts(spark)
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.Vocabulary.load(PIECE_MODEL), keep_text=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written before the next one starts; its input and its own tables are then deleted."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES[:-1]):
        before = docs
        with only_result_stays(spark) as result:
            docs = stage(step(spark, docs, sf_dir))
            result.append(docs)
        if number:
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
