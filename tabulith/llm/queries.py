"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, merkle, ngram, quality, rollup, rules, simhash, suffixes, toxicity, urls, variants, warc
from .common import id_crc, pick
from .oracles import ORACLE_SQL as ORACLE_SQL


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the tokenizer's file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintain(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.spans(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.scan(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.resolved(warc.records(warc.read(spark, path, payload=False))).withColumnRenamed("id", "page_id").drop("uri")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and the root that each row's proof gives once line ends are deleted from the texts of rows of even crc32."""
    fields = {f: F.col(f) for f in merkle.FIELDS}
    tampered = F.when(id_crc() % 2 == 0, merkle.leaf(fields | {"text": F.replace("text", F.lit("\n"))})).otherwise(merkle.leaf(fields))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), keep={"now": tampered})
    folded = merkle.fold(F.col("now"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"), misspell=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_url_filters": op5_url_filters,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_rules": op9_rules,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_variants": op13_variants,
}
