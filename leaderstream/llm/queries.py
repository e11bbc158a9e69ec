"""Registered queries of this folder's operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.session import shared_dir

from . import alignment, chat, embeddings, exact, merkle, minhash, mixing, packing, secrets, token_blocks, toxicity, url_filter, warc
from .tables import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    held_out = toxicity.held_out().alias("held_out")
    return toxicity.scored(docs, model).select("doc_id", held_out, "score", predicted)


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = exact.exact_groups(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.vector_groups(table(spark, sf_dir, "embeddings"), cosine=0.98)


#: A conversation that says control strings itself.
CONTROL = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.digest(chat.formatted(turns.unionByName(hard)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(
        docs, public_tokenizers.path(BYTE_BPE), most_documents=packing.DOCUMENTS, most_cost=packing.COST
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.found(docs, secrets.train(docs))


#: Rules of ``op11_url_filter``.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.features(pages, url_filter.lexicon(pages))
    urls = pages.select("page_id", "url")
    judged = url_filter.judged(urls, url_filter.learn(found), found, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.aligned(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_blocks": op2_token_blocks,
    "op3_mixing": op3_mixing,
    "op4_minhash": op4_minhash,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_embeddings": op7_embeddings,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_url_filter": op11_url_filter,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}
