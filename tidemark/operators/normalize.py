"""Time resolution per file, clock skew across files, and the merged timeline."""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.schema import SKEW_SECONDS


def known_zone(name: Column) -> Column:
    """``name`` if it is a zone of the time zone database, else null."""
    return F.when(name.isin(sorted(zoneinfo.available_timezones())), name)


def own_stamps(entries: DataFrame) -> DataFrame:
    """``entries`` with the stamp they were read with, in UTC and shifted (own), and where it comes from (own_source)."""
    zone = known_zone(F.col("timezone"))
    naive = F.col("offset_s").isNull()
    utc = F.when(~naive, F.timestamp_add("SECOND", -F.col("offset_s"), F.col("ts"))).when(zone.isNotNull(), F.convert_timezone(zone, F.lit("UTC"), F.col("ts"))).otherwise(F.col("ts"))
    shifted = F.timestamp_add("SECOND", F.coalesce("offset_seconds", F.lit(0)), utc)
    own = F.when(F.col("ts").isNotNull(), shifted)
    source = F.when(F.col("ts").isNull(), F.lit(None)).when(~naive, "offset").when(zone.isNotNull(), "zone").otherwise("assumed")
    return entries.withColumn("own", own).withColumn("own_source", source)


def resolve(entries: DataFrame, shifts: Sequence[int] = ()) -> DataFrame:
    """(ts, offset_s, timezone, offset_seconds) to timestamp (UTC) and time_source, file by file.

    With ``shifts`` files of any size are gone through in blocks of lines, see ``scan``.

    A stamp with an offset counts by it; one without counts in the declared zone, or as UTC ('assumed'). The declared
    shift is added to stamps that were read. Events without a stamp carry the one before them; those at the head of a
    file take its earliest.
    """
    read = own_stamps(entries)
    if shifts:
        read = scan.before(read, ["file_id", "file_idx"], "line_no", {"carry": (F.col("own"), "last")}, order=["seq"], shifts=shifts, overall={"earliest": (F.col("own"), "min")})
        filled = F.coalesce("own", "carry", "earliest")
    else:
        in_order = Window.partitionBy("file_idx").orderBy("line_no", "seq").rowsBetween(Window.unboundedPreceding, 0)
        filled = F.coalesce(F.last("own", ignorenulls=True).over(in_order), F.min("own").over(Window.partitionBy("file_idx")))
    return (
        read.withColumn("timestamp", filled)
        .withColumn("time_source", F.coalesce("own_source", F.when(F.col("timestamp").isNotNull(), "carried").otherwise("none")))
        .drop("own_source", "ts", "offset_s", "carry", "earliest")
        .withColumnRenamed("own", "read_at")
    )


def clock() -> list[Column]:
    unresolved = F.col("time_source").isin("assumed", "carried")
    return [F.min("read_at").alias("first"), F.max("read_at").alias("last"), F.count_if(unresolved).alias("unresolved")]


def file_clocks(resolved: DataFrame) -> DataFrame:
    """(file_idx, file_id, first, last, unresolved) over stamps that were read."""
    return resolved.groupBy("file_idx", "file_id").agg(*clock())


#: What skew_warning says; gap_seconds tells how far.
APART = "clock_apart"


def _apart(dated: DataFrame, threshold: int) -> DataFrame:
    """gap_seconds, 0 for windows that overlap, and skew_warning from the nearest end ``before`` and start ``after`` of others."""
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    gap = F.least(seconds(F.col("before"), F.col("first")), seconds(F.col("last"), F.col("after")))  # least takes no nulls
    found = dated.withColumn("gap_seconds", F.when(gap < 0, 0.0).otherwise(gap))
    return found.withColumn("skew_warning", F.when(F.col("gap_seconds") > threshold, F.lit(APART)))


def detect_skew(clocks: DataFrame, threshold: int = SKEW_SECONDS) -> DataFrame:
    """``clocks`` with gap_seconds to the nearest other window, and skew_warning where that is above ``threshold``.

    The nearest windows are those with the latest end among the ones that start no later, and the earliest start among
    the others, so ordered passes over the windows stand in for comparing all pairs. One task orders the files; a batch
    has few. ``skew_of_many`` is for more.
    """
    in_order = Window.orderBy(F.col("first").asc_nulls_first(), "last", "file_idx")  # files without a window come first and have no gap
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return _apart(clocks.withColumn("before", before).withColumn("after", F.when(F.col("first").isNotNull(), F.lead("first").over(in_order))), threshold).drop("before", "after")


def skew_of_many(clocks: DataFrame, threshold: int = SKEW_SECONDS, shifts: Sequence[int] = scan.MICROS) -> DataFrame:
    """The same for any number of files, by running maxima over blocks of time; no task orders all of them.

    ``clocks`` is read several times: have it stored. Files that start within the same second are ordered by one task.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    turned = F.lit(1 << 61)
    dated = clocks.filter("first is not null").withColumns({"_from": turned + micros("first"), "_back": turned - micros("first"), "_end": -micros("last"), "_file": -F.col("file_idx").cast("decimal(20)"), "_top": F.lit(0)})
    found = scan.before(dated, ["_top"], "_from", {"before": (F.col("last"), "max")}, order=["last", "file_idx"], shifts=shifts)
    # The other way round, so that the windows after come before.
    found = scan.before(found, ["_top"], "_back", {"after": (F.col("first"), "min")}, order=["_end", "_file"], shifts=shifts)
    gaps = _apart(found, threshold).select(F.col("file_id").alias("_id"), F.col("file_idx").alias("_idx"), "gap_seconds", "skew_warning")
    return clocks.join(gaps, (F.col("file_id") == F.col("_id")) & (F.col("file_idx") == F.col("_idx")), "left").drop("_id", "_idx")


def timeline(entries: DataFrame) -> DataFrame:
    """By time, undated events first; equal stamps by file identifier as a string, line and order in the line."""
    return entries.orderBy(F.col("timestamp").asc_nulls_first(), "file_id", "line_no", "seq")


def within_budget(entries: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` entries in order of file and position, without one task ordering all of them.

    Counts per file give the place at which each file begins; entries are numbered within their file.
    """
    sizes = entries.groupBy("file_idx").agg(F.count(F.lit(1)).alias("in_file"))
    begin = F.sum("in_file").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_file")
    starts = sizes.withColumn("begin", begin).select("file_idx", "begin")
    number = F.row_number().over(Window.partitionBy("file_idx").orderBy("line_no", "seq"))
    return entries.withColumn("number", number).join(starts, "file_idx").filter(F.col("begin") + F.col("number") <= limit).drop("number", "begin")
