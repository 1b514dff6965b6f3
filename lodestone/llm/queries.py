"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import hamming_topk as _hamming
from lodestone.llm import mixing as _mixing
from lodestone.llm import oracle
from lodestone.llm import vector_codes as _codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import hamming_topk

    return hamming_topk.report(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import packed_ids

    return packed_ids.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import html_extract

    return html_extract.report(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import ppm

    return ppm.scores(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import whitening

    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import mixing

    return mixing.report(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import vector_codes

    return vector_codes.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_hamming_topk, op2_byte_bpe, op3_suffix_dedup, op4_minhash_near_dedup, op5_packed_ids, op6_toxicity, op7_pii, op8_decontamination, op9_html_extraction, op10_lm_scoring, op11_whitening, op12_source_mixing, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {"op1_hamming_topk": _hamming.ORACLE, "op3_suffix_dedup": oracle.SUFFIX_DEDUP, "op4_minhash_near_dedup": oracle.NEAR_DUPLICATES, "op8_decontamination": oracle.DECONTAMINATION, "op12_source_mixing": _mixing.ORACLE, "op13_vector_codes": _codes.ORACLE}
