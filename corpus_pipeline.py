"""The corpus pipeline: language, civility, near-duplicates, benchmark leaks, subword ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of `documents`. The models of the first two stages are learnt from the stage's own input, and
from the rows of `labels` that belong to it. A table without rows passes through as a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwise.llm import language, toxicity
from barwise.llm.common import settled_table, table
from barwise.llm.decontamination import decontaminate
from barwise.llm.near_text import keep_distinct
from barwise.llm.pieces import encode


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters or without a language that holds a third go."""
    return language.keep_identified(docs, language.train(docs))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 for toxicity."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by SimHash or by five-word shingles.

    Fingerprints link as in op1_simhash, at 4 or fewer bits. That is far tighter than near copies go, so sets of
    five-word shingles at similarity 0.8 or more link too.
    """
    return keep_distinct(docs, simhash=True)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of `benchmark`."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of every document left."""
    return encode(docs)


STAGES = [
    ("language identification", identified),
    ("toxicity", civil),
    ("simhash near-dedup", distinct),
    ("benchmark decontamination", unleaked),
    ("sentencepiece encoding", encoded),
]

#: The fitted models can't be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
