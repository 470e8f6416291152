"""Entries as a transcript for a reader with a limited context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_CHARS_PER_TOKEN, PROSE_CHARS_PER_TOKEN = 3.4, 3.9


def iso_text(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction only where it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00"))


def rendered(entries: DataFrame) -> DataFrame:
    """``entries`` with rendered: stamp or -, level, service and message on one line."""
    line = F.concat(F.coalesce(iso_text(F.col("timestamp")), F.lit("-")), F.lit(" "), F.rpad(F.upper("level"), 8, " "), F.lit(" "), F.col("service"), F.lit(": "), F.col("message"))
    return entries.withColumn("rendered", line)


def left_out(chars: Column) -> Column:
    # Fixed value: the note that stands for the middle of a long transcript.
    return F.concat(F.lit("\n\n… ["), F.format_number(chars, 0), F.lit(" characters of the middle omitted] …\n\n"))


def transcript(entries: DataFrame, *by: str, max_chars: int = 60_000) -> DataFrame:
    """(by, prompt): the entries of a group in the order of the timeline, or its first and last half of ``max_chars``.

    Offsets of lines tell which of them reach into a half; no others are gathered.
    """
    half = max_chars // 2
    in_order = Window.partitionBy(*by).orderBy(F.col("timestamp").asc_nulls_first(), "file_id", "line_no", "seq")
    size = F.length("rendered") + 1
    placed = rendered(entries).withColumns(
        {"until": F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - 1, "total": F.sum(size).over(Window.partitionBy(*by)) - 1, "place": F.row_number().over(in_order)}
    )
    head, tail = F.col("until") - F.length("rendered") <= half, F.col("until") >= F.col("total") - half
    near = placed.filter(head | tail | (F.col("total") <= max_chars)).withColumns({"head": head, "tail": tail})
    all_of = near.groupBy(*by, "total").agg(F.sort_array(F.collect_list(F.struct("place", "rendered", "head", "tail"))).alias("all"))

    def joined(keep: str | None = None) -> Column:
        rows = F.filter("all", lambda x: x[keep]) if keep else F.col("all")
        return F.array_join(F.transform(rows, lambda x: x.rendered), "\n")

    cut = F.concat(F.left(joined("head"), F.lit(half)), left_out(F.col("total") - max_chars), F.right(joined("tail"), F.lit(half)))
    return all_of.select(*by, F.when(F.col("total") <= max_chars, joined()).otherwise(cut).alias("prompt"))


def log_tokens(chars: Column) -> Column:
    """Estimated tokens of log text; halves go to the even neighbour."""
    return F.bround(chars / LOG_CHARS_PER_TOKEN).cast("long")


def prose_tokens(chars: Column) -> Column:
    return F.bround(chars / PROSE_CHARS_PER_TOKEN).cast("long")
