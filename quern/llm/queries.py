"""Queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, lexical, merkle, packing, secrets, simhash, substring, superminhash, token_counts, toxicity, warc, winnowing
from . import pipeline as stages
from .common import arrow_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "at", "word", "before", "after", "path", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "score", "is_secret")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(table(spark, sf_dir, "conversations").select(extra.columns).unionByName(extra))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.repeats(table(spark, sf_dir, "documents"), window=13)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attributed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), rule="first")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_substring": op5_substring,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_winnowing": op8_winnowing,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_superminhash": op13_superminhash,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination.SQL,
    "op4_chat": chat.SQL,
    "op5_substring": substring.SQL,
    "op6_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
    "op12_lexical": lexical.SQL,
    "op13_superminhash": superminhash.SQL,
}
