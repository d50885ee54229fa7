"""The registered queries of this subpackage: each operator over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auctionstream.llm import conversation_repair, decontamination, licenses, mixing, pii, quality, repeats, sharding, simhash, token_counts, token_files, toxicity, whitening
from auctionstream.llm.common import documents
from auctionstream.session import work_folder

SHARDS = 24
END_ID = 2


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean(documents(spark, folder)).drop("clean_text", "kept_chars")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(documents(spark, folder), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.contaminated(documents(spark, folder), benchmark).drop("doc_key", "text_hash")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(documents(spark, folder))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).drop("spans", "kept")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "token-files")
    token_files.write_tokens(documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_documents(spark, path)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.not_held_out("doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (~toxicity.not_held_out("doc_id")).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending")
    )


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(documents(spark, folder))


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(documents(spark, folder))
    counts = [F.size(pii.base(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    digest = F.sha2(pii.listed(pii.base(F.col("spans"))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed(F.col("spans")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    return conversation_repair.digest(conversation_repair.repair(rows))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.STATEMENT}
