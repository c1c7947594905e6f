"""One query per operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import (centroid_clustering, decontamination, embedding_dedup, fingerprints, hard_negatives, jaccard_join, language_id, licence_scan, packing, secret_scan, sentencepiece_codec, sharding,
                           suffix_dedup)
from matchgrid.llm.common import read_table
from matchgrid.llm.sql import CLUSTERS, JACCARD, LEAKS, LICENCES, NEGATIVES, SHARDS

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
END_ID = 2
SHARD_BYTES = 1 << 20


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vocab = public_tokenizers.path(PIECES)
    labels, model = language_id.fit(language_id.sample(docs.where(~language_id.held_out())), vocab)
    found = language_id.predict(docs, vocab, labels, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))[0]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END_ID, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.sha2(secret_scan.span_text(secret_scan.KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secret_scan.span_text().alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))[0]


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.report(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_licence_scan, op3_embedding_dedup, op4_packing, op5_secret_scan, op6_jaccard_join, op7_fingerprints, op8_suffix_dedup, op9_sharding,
              op10_sentencepiece, op11_decontamination, op12_centroid_clustering, op13_hard_negatives)
}

ORACLES: dict[str, str] = {"op2_licence_scan": LICENCES, "op6_jaccard_join": JACCARD, "op9_sharding": SHARDS, "op11_decontamination": LEAKS,
                           "op12_centroid_clustering": CLUSTERS, "op13_hard_negatives": NEGATIVES}
