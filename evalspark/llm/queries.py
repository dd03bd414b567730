"""The registered queries of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import byte_bpe, conversation_trie
from evalspark.llm.embedding_dedup import near_vectors
from evalspark.llm.fill_in_middle import fill_in_middle, restored, store_frames, with_digests
from evalspark.llm.licenses import scan_licenses
from evalspark.llm.line_dedup import dedup_lines
from evalspark.llm.oracles import oracle_sql
from evalspark.llm.packing import pack_documents
from evalspark.llm.pieces import MARK, decode, encode
from evalspark.llm.quality_lm import quality_scores
from evalspark.llm.quality_rules import quality_rules
from evalspark.llm.simhash import as_hex, simhash_components
from evalspark.llm.substring_dedup import dedup_substrings
from evalspark.llm.token_counts import token_counts

__all__ = ["oracle_sql", "queries"]

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{sf_dir}/labels.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_removed", "gone", "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("matches")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", as_hex(found["fp"]).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir)).drop("lang")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; a word mark in a text comes back as a blank."""
    coded = decode(encode(documents(spark, sf_dir), ("doc_id", "text")))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", (F.col("decoded") == plain).alias("same"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("lang")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.schema(CONVERSATIONS).parquet(f"{sf_dir}/conversations.parquet")
    trie = conversation_trie.prefix_trie(*conversation_trie.rebuilt_turns(conversations))
    key = conversation_trie.KEY
    ended = trie.nodes.join(conversation_trie.end_digests(trie.ends), key, "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return ended.drop("k1", "k2", "turn_key", "words").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return byte_bpe.encode(documents(spark, sf_dir)).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode(ids), 256).alias("decoded_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = restored(fill_in_middle(store_frames(documents(spark, sf_dir))))
    return with_digests(moved, {"output": "output_sha256", "restored": "restored_sha256"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_substring_dedup,
        op2_license_scan,
        op3_line_dedup,
        op4_embedding_dedup,
        op5_token_counts,
        op6_simhash,
        op7_packing,
        op8_quality_classifier,
        op9_pieces,
        op10_quality_rules,
        op11_prefix_trie,
        op12_byte_bpe,
        op13_fill_in_middle,
    ]
    return {f.__name__: f for f in named}
