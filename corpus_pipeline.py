"""From raw documents to packed training sequences, in five stages.

Each stage is given all documents that the one before kept, and its decisions
take effect: documents leave with all their columns or stay with all of them.
Stages drop by id and text, so rows with one id and different texts have fates
of their own; only near-dedup takes them for one document, by id.  The list of
what is dropped is broadcast when it was counted to be short and joined by
shuffling otherwise.  Rows with a null id are kept by the stages that compare
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, crc_bucket
from tallyloom.llm.decontaminate import find_contaminated
from tallyloom.llm.exact_dedup import exact_dedup
from tallyloom.llm.language_id import fit_languages, recognised
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.scratch import cut

#: More dropped rows than this are joined by shuffling, not broadcast.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """``docs`` without the rows that have a key of ``dropped``."""
    keys = broadcast_if_small(cut(dropped.distinct(), label), BROADCAST_ROWS)
    return docs.join(keys, keys.columns, "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that the nearest-centroid
    model rejects go, and so do texts without a letter."""
    model = fit_languages(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    return docs.where(recognised(F.col("text"), model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    found = exact_dedup(keyed.withColumn("_row", F.struct("doc_id", "_text")), id_col="_row")
    return _without(keyed, found.where("not kept").select("doc_id.doc_id", "doc_id._text"), "dropped-exact").drop("_text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at a similarity of 0.8 or more,
    the document with the smallest id."""
    found = near_duplicates(docs, percent=80, bands=40, band_size=5)
    return _without(docs, found.where("not kept").select("doc_id"), "dropped-near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = find_contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return _without(keyed, found.select(F.col("doc_id").alias("_row")), "dropped-benchmark").drop("_row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), lot_bytes=1 << 21)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Trained models, sketches and the tokenizer are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
