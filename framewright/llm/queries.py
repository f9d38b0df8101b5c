"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import ann, bpe, chroma, langid, lm, mixing, sharding, simhash, substrings, toxicity
from framewright.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


#: Bytes of a shard at most.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "depth", "n_bytes")


#: Target shares of the languages.
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "lang"), WEIGHTS, "lang")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", as_audio=chroma.render)
    return chroma.align(prints, lambda i: i % 20 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_simhash": op2_simhash, "op3_ann": op3_ann, "op4_suffix_dedup": op4_suffix_dedup, "op5_language": op5_language, "op6_sharding": op6_sharding, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_lm_score": op9_lm_score, "op10_chroma": op10_chroma}
ORACLE_SQL: dict[str, str] = {"op6_sharding": sharding.oracle(SHARD_BYTES), "op7_mixing": mixing.oracle(WEIGHTS, "lang")}
