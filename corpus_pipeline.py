"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return documents' columns, extra ones and such that
share names with columns the operators use inside included. An empty table stays empty through all stages. Null texts count as
empty ones; rows with a null id are never dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.exact_dedup import drop_copies
from gneiss.llm.mixing import mixed_documents
from gneiss.llm.packing import pack
from gneiss.llm.shared import staged
from gneiss.llm.simhash import drop_near_copies
from gneiss.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts have no hits; without toxic and clean labels to learn from,
    all scores are the share of toxic labels (0.5 with no labels), which is under the threshold unless nearly all are toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; all null and blank texts are one text. Rows that repeat an id share its fate."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near fingerprints the smallest id stays; texts without words all have fingerprint zero."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, to the nearest whole number; documents without words go.
    A null source is a source of its own, last in order. Ties of hashes are broken by id."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences, one for each time a document stands in the mix; a null text is its end alone."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("packing", packing)]

#: The first stage's classifier is not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each one's rows staged for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
