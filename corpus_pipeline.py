"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.llm import exact, minhash, mixing, packing, toxicity
from leaderstream.llm.queries import BYTE_BPE
from leaderstream.llm.tables import free_name, kept, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, by a model of all documents and labels that there are."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.scored(docs, model, column=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_groups(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, whatever the ids of its rows."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(
        docs, public_tokenizers.path(BYTE_BPE), most_documents=packing.DOCUMENTS, most_cost=packing.COST
    )


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Toxicity is learned, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = kept(docs, f"pipeline-{number}")
    return docs
