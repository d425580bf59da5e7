"""The queries of this subpackage, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.llm import compaction, jaccard_join, knn_tiles, line_dedup, mixing, packing, pairwise_quality, pii, quality_rules, token_store
from feldspar.llm.common import new_dir
from feldspar.llm.sql import ORACLES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_tiles.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents in two arrivals, compacts, and reads the newest version back: where each row lies, and its text's size and checksum."""
    store = compaction.ShardStore(spark, new_dir(spark, "shards"), target_bytes=64 << 20, fanout=4)
    docs = _table(spark, sf_dir, "documents")
    for part in range(2):  # two arrivals
        store.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part, F.lit(part == 0))))
    store.compact()
    store.vacuum(grace_seconds=0)  # the store has no other writer
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return store.read().select("doc_id", "shard_id", "row_in_shard", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(_table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end_id=0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(k for k in pii.KINDS if k.base)
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(pii.KINDS).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "tokens")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=1)
    return token_store.read_documents(spark, path).drop("ids")


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pairwise_quality.score(docs, pairwise_quality.train(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_nearest, op3_compaction, op4_jaccard_join, op5_line_dedup, op6_packing, op7_pii, op8_mixing, op9_token_store, op10_pairwise_quality)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
