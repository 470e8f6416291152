"""A training corpus from documents: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. Only the last one adds
columns to those of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, mixing, quality, sharding
from tidemark.llm.common import bounded, table, work_table

N_SHARDS = 24


def measured_docs(docs: DataFrame, keep: list[str], label: str) -> DataFrame:
    """The columns ``keep``, rates, their metrics and the whole row as _doc.

    Written as a work table, which gives Python few texts at a time: the caller of a stage, who runs the plan it
    returns, may have other settings.
    """
    whole = docs.withColumn("_doc", F.struct(*docs.columns))
    return quality.with_rates(work_table(quality.with_metrics(whole, keep=[*keep, "_doc"]), f"{label}-metrics"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled level of their language reject go.

    Null and empty texts fail the base. Rows are judged one by one, repeated ones alike. Empty table: no rows.
    """
    measured = measured_docs(docs, ["doc_id", "lang"], "quality")
    judged = quality.verdict(measured, quality.fitted_cutoffs(measured, table(spark, sf_dir, "labels")), "lang")
    return judged.filter("kept").select("_doc.*")


def row_key(docs: DataFrame) -> Column:
    """What tells rows of another identifier or text apart; in order of identifiers, those without one last."""
    unnamed = F.lit("0").cast(docs.schema["doc_id"].dataType)
    return F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", unnamed).alias("id"), F.xxhash64("text").alias("h"), F.hash("text").alias("g")
    )


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest identifier of each component of near duplicates stays, in one copy.

    Rows are judged one by one, whether they have an identifier, share it or not. Rows that repeat an identifier and
    its text are one. Null and empty texts are like nothing else. Empty table: no rows.
    """
    keyed = docs.withColumn("_row", row_key(docs))
    found = work_table(jaccard.jaccard_components(keyed.select("_row", "text"), key="_row"), "pipeline-components")
    by_row = found.groupBy("_row").agg(F.min(F.col("component_id") < F.col("_row")).alias("gone"), F.count(F.lit(1)).alias("rows"))
    gone = work_table(by_row.filter("gone").select("_row"), "pipeline-copies")
    kept = keyed.join(bounded(gone, 96), "_row", "left_anti")
    repeated = work_table(by_row.filter("rows > 1 and not gone").select("_row"), "pipeline-repeats")
    again = bounded(repeated, 96)
    once = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(again, "_row", "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go.

    Null and empty texts hold none. Rows are judged one by one, repeated ones alike. Empty tables: no rows, or all stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, action="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken. Rows that repeat an identifier are drawn together. Sources
    by code point, null last. Empty table: no rows.
    """
    measured = measured_docs(docs, ["doc_id", "source"], "mix")
    mixed = mixing.mix_sources(measured, size=F.col("n_words"), weight=quality.quality_weight())
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with virtual_slot and shard, by a slot map balanced for their bytes.

    Null texts count no bytes; rows of one identifier share a slot; columns of these names are replaced. Empty table:
    no rows.
    """
    slot_map = sharding.balanced_map(docs, "doc_id", sharding.record_size(F.col("text")), N_SHARDS)
    added = ("virtual_slot", "shard")
    return sharding.place(docs, "doc_id", slot_map).select(*[c for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Exact binomial bounds and components of links are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work_table(docs, f"pipeline-{name}")
    return docs
