"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_norm_clustering,
    byte_cnn,
    chat_formatting,
    collision_search,
    hypergeometric_sharding,
    risk_thresholds,
    separator_scan,
    simhash_dedup,
    slack_packing,
    substring_dedup,
    systematic_mixing,
    target_resampling,
    temporal_list_join,
)
from ._shared import read_table, whole_text


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_classes(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return temporal_list_join.listed_captures(temporal_list_join.captures_of(pages), temporal_list_join.entries_of(pages))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest_neighbours(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = hypergeometric_sharding.shard_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    text = whole_text()
    return sharded.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return risk_thresholds.quality_verdicts(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_mixing.mixture(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = slack_packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_cnn.quality_scores(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_block_norm_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_norm_clustering.clustered(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_collapsed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resampled(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "text"))


def op13_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.conversation_digests(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_separator_scan,
        op2_simhash_bktree,
        op3_fingerprint_index,
        op4_temporal_list_join,
        op5_collision_counting,
        op6_hypergeometric_sharding,
        op7_risk_controlled_rules,
        op8_systematic_mixing,
        op9_minimum_bin_slack,
        op10_byte_cnn,
        op11_block_norm_clustering,
        op12_collapsed_resampling,
        op13_schema_fingerprints,
    )
}
ORACLE_SQL = {
    "op3_fingerprint_index": substring_dedup.ORACLE_SQL,
    "op4_temporal_list_join": temporal_list_join.ORACLE_SQL,
    "op7_risk_controlled_rules": risk_thresholds.ORACLE_SQL,
    "op8_systematic_mixing": systematic_mixing.ORACLE_SQL,
    "op11_block_norm_clustering": block_norm_clustering.ORACLE_SQL,
    "op13_schema_fingerprints": chat_formatting.ORACLE_SQL,
}
