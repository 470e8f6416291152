"""Queries of the corpus operators by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, html_extract, jaccard, lexical, licenses, line_dedup, mixing, neighbours, pii, quality, resampling, sharding, warc
from tidemark.llm.common import table, text_or_empty, work_table
from tidemark.llm.oracles import ORACLES

N_SHARDS = 24


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.with_rates(quality.with_metrics(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]))
    rows = work_table(measured.select("doc_id", "source", "n_words", quality.quality_weight().alias("weight")), "mix-rows")
    mixed = mixing.mix_sources(rows, size=F.col("n_words"), weight=F.col("weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("text_crc32"))
    slot_map = sharding.balanced_map(rows, "doc_id", F.col("size"), N_SHARDS)
    placed = sharding.place(rows, "doc_id", slot_map)
    numbered = sharding.number_in_shard(placed, ["doc_id", "size", "text_crc32"], F.xxhash64("doc_id", "text_crc32"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=85)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.with_contamination(docs, table(spark, sf_dir, "benchmark"), n=10)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.joined_spans("pii", pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.joined_spans("pii", pii.KINDS).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = work_table(quality.with_metrics(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]), "quality-metrics")
    rated = quality.with_rates(measured)
    judged = quality.verdict(rated, quality.fitted_cutoffs(rated, table(spark, sf_dir, "labels")), "lang")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, buckets=10_000, seed=7)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_mix_sources, op2_extract_text, op3_line_dedup, op4_license_scan, op5_virtual_slots, op6_warc_index, op7_jaccard_join,
        op8_decontaminate, op9_pii_anchors, op10_quality_rules, op11_ranked_search, op12_nearest_neighbours, op13_importance_resample, pipeline,
    )
}

__all__ = ["ORACLES", "QUERIES"]
