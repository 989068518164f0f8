"""A corpus pipeline of five stages: quality, near-dedup, secrets, mixing, encoding. Counted as part of mossgraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of ``documents``.

For all stages: columns other than doc_id, text, source and lang are carried along, whatever their names; null texts
count as empty and stay null; texts are read whole, however long; an empty table gives an empty one. What a stage does
with null ids, repeated rows and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgraph.llm import automaton, minhash, pieces, raking, subwords
from mossgraph.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: those that score 0.3 or more.

    Rows with a null doc_id, repeated rows and empty texts are scored like others, by text alone, so equal texts share
    their fate; a score of just 0.3 stays. Without labels every score is 0.5 and all rows stay.
    """
    return subwords.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Rows that share that doc_id stay together. Rows with a null doc_id go if their group has a doc_id, and one of a
    group without any stays. Texts without words are nobody's duplicates and all stay.
    """
    return minhash.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the name of their kind; n_chars follows (0 for a null text).

    Every row is kept, repeated ones and those with a null doc_id too; of overlapping secrets the first one's kind stands.
    """
    return automaton.redacted(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights.

    A null source or lang counts as an empty one, a null doc_id as -1 in the draw; rows with one doc_id are drawn
    alike within a cell; cells without tokens (empty texts only) are kept whole.
    """
    return raking.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids: doc_id, source, lang, part, parts, ids; a giant document has a row for each of its parts.

    Repeated rows and rows with a null doc_id are encoded each; an empty text has one row with no ids.
    """
    return pieces.encoded(docs, columns=("doc_id", "source", "lang"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: The stages' methods can't be stated in SQL; they are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
