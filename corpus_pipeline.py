"""From raw documents to packed training sequences: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's
result as Parquet to the session's shared folder and reads it back for the next one. All but the
last return the columns of documents; the mix is in the order of its files and their rows, which packing reads.

Defined cases follow the operators': null texts count as empty; very long texts pass through every
stage whole; of repeated rows and other ties one stays after the second stage (the least doc_id, nulls
last); an empty table passes through all stages; other columns, whatever their names, are kept up to
the last stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm.common import release, table
from hirelake.llm.mixing import mix_documents
from hirelake.llm.near_dedup import drop_near_duplicates
from hirelake.llm.packing import pack_in_order
from hirelake.llm.toxicity import drop_toxic
from hirelake.storage import finish


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; labels teach the score as in op10."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, which goes on with the other sources when one runs dry."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences, which follow the order of the mix."""
    return pack_in_order(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can neither fit the classifier nor tokenise; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own intermediate tables go when its result is written, its input with them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        result = finish(partial(stage, spark, docs, sf_dir), name)
        if i:
            release(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
