"""One query per operator, over the whole of its table, and the oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm import (
    centroids,
    classifier,
    frames,
    html,
    minhash,
    mixing,
    packing,
    personal,
    quality,
    sharding,
    suffix,
    vectors,
    whitening,
)
from leadlake.llm.common import read

SHARDS = 40
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.0, 4, 42


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = quality.corpus_weights(docs, quality.trusted_ids(read(spark, sf_dir, "labels")))
    return docs.select("doc_id", quality.verdict(F.col("text"), weights).alias("v")).select("doc_id", "v.*")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), least=0.95)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(read(spark, sf_dir, "documents"))
    return mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, read(spark, sf_dir, "labels")))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_sharding": op4_sharding,
    "op5_product_quantisation": op5_product_quantisation,
    "op6_html_extraction": op6_html_extraction,
    "op7_minhash": op7_minhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_classifier": op10_classifier,
    "op11_personal_data": op11_personal_data,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op9_mixing": mixing.oracle(MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op12_centroid_clustering": centroids.oracle(),
}
