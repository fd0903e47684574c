"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents. A stage's result reads tables that
the stage has written for itself; they stay, since only the caller knows when the result has been read. ``run``
writes each result and then deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import packing, pii, quality, queries, simhash, toxicity
from specloom.llm.common import materialize, read, release, tables_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # toxicity, personal data and packing are beyond SQL; tests/llm holds the pipeline against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written once in the shared folder; what a stage has read or
    written for itself is deleted as soon as its result is written. What the last result reads stays."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, one in STAGES[:-1]:
        with tables_made() as made:
            out = one(spark, docs, sf_dir)
        docs = materialize(out, f"stage-{name}")
        for table in (*made, last):
            release(table)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
