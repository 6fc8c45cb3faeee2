"""A corpus pipeline of four stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiltwork.llm import language_id, near_dedup, packing, quality_rules
from quiltwork.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, and those that no language model compresses, go.

    Null and empty texts go.  Every row is judged by its own text, long ones whole, so repeated rows and rows without
    doc_id fare alike; columns of any names are carried along.  Without a labelled language, and so on an empty table,
    nothing is left.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a risk-controlled cutoff rejects.

    Null and empty texts go by the base rule (fewer than 10 words).  Rows are judged one by one by text and language;
    without labels only the base rule is left.  Columns of any names are carried along; an empty table stays empty.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the least id.

    Texts without words are near nothing and stay.  Rows that repeat doc_id and text stay once; rows without doc_id go
    where a group has others, else those of one text stay, once.  Columns of any names are carried along; an empty table
    stays empty.
    """
    return near_dedup.keep_one(docs, width=5, threshold=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens.

    A null or empty text is one end token; long texts are cut; repeated rows and rows without doc_id are packed as they
    come; other columns are left out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", remove_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can't express the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again before the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
