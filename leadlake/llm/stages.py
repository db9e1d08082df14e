"""The stages of the corpus pipeline. Each keeps the columns of documents but the last.

A stage takes whatever its predecessor wrote. Rows without an id pass the stages that decide
by id; extra columns pass all of them; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm import minhash, mixing, packing, quality, suffix
from leadlake.llm.common import read
from leadlake.session import store

MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 1, 42


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    weights = quality.corpus_weights(docs, quality.trusted_ids(read(spark, sf_dir, "labels")))
    return docs.where(quality.verdict(F.col("text"), weights)["kept"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays, once; rows without an id stay.

    Unlike texts under one id are documents of their own; of those in one class the least text stays.
    """
    classes = minhash.text_classes(docs)
    staying = store(classes.where("kept and doc_id is not null").select(F.col("doc_id").alias("staying"), F.col("key").alias("of")).distinct())
    # The ids that stay grow with the documents, so both sides are shuffled by id at every size.
    key = minhash.key_of(docs["text"])
    held = docs.join(staying.hint("merge"), (docs["doc_id"] == staying["staying"]) & (key == staying["of"]), "left_semi")
    return held.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes, and runs of over 50 words, that occur elsewhere too are cut out of the texts; n_chars follows. Every row stays."""
    return suffix.without_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is cut to its share of nine tenths of the tokens.

    The corpus is free of copies by now, so a document comes once at most: one epoch.
    """
    mixed = mixing.mix(mixing.with_domain(docs), mixing.LEVELS, mixing.WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    copies = store(mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0").select(F.col("doc_id").alias("taken")))
    return docs.join(copies.hint("merge"), docs["doc_id"].eqNullSafe(copies["taken"]), "left_semi")


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 2048 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1, release=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
