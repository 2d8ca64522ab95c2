"""The subpackage's queries, thin digests of the operators' outputs, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, divergence, langid, lines, media, mixing, neardup, packing, pii, quality, sharding, toxicity, urls
from .common import table
from .oracles import oracle_sql  # noqa: F401  (part of this module's interface)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_curve(table(spark, sf_dir, "documents"), 16)


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.read_media(media.to_media(table(spark, sf_dir, "documents")))
    return m.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.detect(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.expr(pii.rendered("spans")), 256).alias("base_sha256"), F.expr(pii.rendered("concat(spans, terms)")).alias("spans"))


def op11_mph_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_yinyang_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    names = sorted((k for k in globals() if k.startswith("op") and k[2].isdigit()), key=lambda k: int(k[2:].split("_")[0]))
    return {k: globals()[k] for k in names}
