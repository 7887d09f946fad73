"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spans, ann, bpe, chat, decontaminate, neardup, pii, quality, secrets, sharding, substring
from .oracles import ORACLES  # noqa: F401


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def _digest(found: str, base: tuple[str, ...]) -> list:
    spans = F.col(found)
    counts = [_spans.count(spans, k).alias(f"n_{k}") for k in base]
    return [*counts, F.sha2(_spans.joined(_spans.only(spans, *base)), 256).alias("base_sha256"), _spans.joined(spans).alias("spans")]


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    scores = F.concat_ws(",", F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string"))).alias("scores")
    return seen.select("doc_id", *_digest("pii", pii.BASE), scores)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark)
    seen = ledger.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return seen.select(F.col("path").alias("doc_id"), *_digest("findings", secrets.BASE))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = decontaminate.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_items = F.size("items").cast("long")
    return seen.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.Index(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).search(every=100, k=10)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2)
    return got.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "p_weak", "score", "kept", "toxic")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_secrets, op4_decontaminate, op5_ann, op6_substring, op7_neardup, op8_chat, op9_quality, op10_bpe)}
