"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, collocations, html_text, media, mixing, packing, pii, quality_rules, repeats, sharding, simhash, url_filter, vector_codes
from .common import read


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.write_media(read(spark, sf_dir, "documents")))


def op2_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), url_filter.RULES, url_filter.listed_hosts(spark))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's rules with language and length in the place of the host, so that some hosts are rejected."""
    length = F.least(F.lit(9), F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 100))
    docs = read(spark, sf_dir, "documents").withColumn("source", F.concat_ws(":", F.coalesce("lang", F.lit("")), length.cast("string")))
    return quality_rules.quality_verdicts(docs).withColumn("host_rate", F.round("host_rate", 9))


BY_LENGTH = "coalesce(lang, '') || ':' || least(9, length(coalesce(text, '')) // 100) AS source"
QUERIES = {f.__name__: f for f in (op1_media, op2_classifier, op3_mixing, op4_pii, op5_packing, op6_repeats, op7_simhash, op8_sharding, op9_quality_rules, op10_url_filter, op11_html, op12_vector_codes, op13_collocations, host_rules)}
ORACLE = {
    "op3_mixing": mixing.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op10_url_filter": url_filter.ORACLE, "op12_vector_codes": vector_codes.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "host_rules": quality_rules.ORACLE.replace("doc_id, source,", f"doc_id, {BY_LENGTH},", 1),
}
