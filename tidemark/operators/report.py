"""Per-file reports, coverage and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.normalize import timeline


def file_report(described: DataFrame, detected: DataFrame, counted: DataFrame) -> DataFrame:
    """One row per source, those without entries included; ``counted`` as for ``joined_report``."""
    sizes = described.select(
        "file_idx", "file_id", "name", "service", "role",
        F.octet_length("content").alias("bytes"),
        F.when(F.col("content") == "", 0).otherwise(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
    )
    return joined_report(sizes, detected, counted.drop("file_id"))


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("entry_count"), F.count("trace_id").alias("with_trace_id"), F.count_if(F.size("correlation_keys") > 0).alias("with_correlation_key")]


def joined_report(sizes: DataFrame, detected: DataFrame, counted: DataFrame) -> DataFrame:
    """The report of ``sizes`` (file_idx, file_id, name, service, role, bytes, line_count) and what was ``counted`` in each:
    ``counts``, made before the budget, and clocks with skew_warning."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        sizes.join(detected, "file_idx", "left").join(counted, "file_idx", "left")
        .select(
            "file_idx", "file_id", "name", "service", "role", "format", F.round("confidence", 3).alias("confidence"), "flavor", "evidence", F.col("overridden").alias("format_overridden"),
            "bytes", "line_count", zero("entry_count").alias("entry_count"), F.col("first").alias("first_at"), F.col("last").alias("last_at"), zero("unresolved").alias("unresolved"),
            (zero("made") - zero("entry_count")).alias("dropped"), zero("with_trace_id").alias("with_trace_id"), zero("with_correlation_key").alias("with_correlation_key"), "skew_warning",
        )
    )


def coverage(entries: DataFrame) -> DataFrame:
    """One row: entry_count, trace and correlation coverage rounded to 4 places, first and last stamp."""
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    return entries.agg(
        F.count(F.lit(1)).alias("entry_count"), share(F.col("trace_id").isNotNull()).alias("trace_coverage"), share(F.size("correlation_keys") > 0).alias("correlation_coverage"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


def coverage_cube(entries: DataFrame, lg: int = 12) -> DataFrame:
    """(service, role, level, grouped, n, with_trace_id, with_correlation_key, traces): coverage by all sets of the three.

    ``grouped`` has a bit for each of them that is summed over, service first. ``traces`` is a mergeable sketch of the
    distinct trace identifiers, with a standard error of about 0.83 / sqrt(2^lg), 1.3 % by default; null without any.
    """
    return entries.cube("service", "role", "level").agg(
        F.grouping_id().cast("int").alias("grouped"), F.count(F.lit(1)).alias("n"), F.count("trace_id").alias("with_trace_id"),
        F.count_if(F.size("correlation_keys") > 0).alias("with_correlation_key"), F.hll_sketch_agg("trace_id", lg).alias("traces"),
    )


def merged_cube(cubes: DataFrame) -> DataFrame:
    """The cube of several batches from the rows of their cubes."""
    summed = [F.sum(c).alias(c) for c in ("n", "with_trace_id", "with_correlation_key")]
    return cubes.groupBy("service", "role", "level", "grouped").agg(*summed, F.hll_union_agg("traces").alias("traces"))


def batch_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("entry_count").alias("entry_count"), F.sum("dropped").alias("dropped_lines"), F.coalesce(F.bool_or(F.col("skew_warning").isNotNull()), F.lit(False)).alias("skew_suspected"))


def preview(entries: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` entries of the timeline."""
    return timeline(entries).limit(n)


def to_rows(entries: DataFrame) -> DataFrame:
    """Entries for export: the stamp as ISO text, '' where there is none; maps as JSON."""
    stamp = F.coalesce(F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")), F.lit(""))
    return entries.withColumn("timestamp", stamp).withColumn("attributes", F.to_json("attributes")).withColumn("correlation_keys", F.to_json("correlation_keys"))
