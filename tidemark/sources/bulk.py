"""Folders of log files of any number and size, as lines: nothing is held as one string or listed on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.sources.files import DEFAULTS, LINE_ENDS, resolved_service

#: Bits of a byte position within which the splits of a file are counted by one task: some 65,000 splits.
SPLITS = (43, 63)


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name, bytes) of all files below ``path``, without what is in them; files of no bytes are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("_metadata.file_path").alias("file_id"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("_metadata.file_size").alias("bytes"))


def lines_below(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name, line_no, line) of the non-blank lines of all text files below ``path``; numbers count blank lines.

    Files are read in splits. A line is numbered within its split, which is bounded by the split size, and the counts
    of the splits before it in its file are added, so no file meets in one task for that. Lines end where those of a
    batch do.
    """
    read = spark.read.option("recursiveFileLookup", True).text(path)
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = read.select(at[0].alias("file_id"), at[1].alias("block"), F.monotonically_increasing_id().alias("id"), F.posexplode(F.split("value", LINE_ENDS, -1)).alias("pos", "line"))
    blocks = rows.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = scan.before(blocks, ["file_id"], "block", {"before": (F.col("n"), "sum")}, shifts=SPLITS).drop("n")
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "block").orderBy("id", "pos"))).join(blocks, ["file_id", "block"])
    number = F.coalesce("before", F.lit(0)) + F.col("rank")
    named = numbered.select("file_id", F.element_at(F.split("file_id", "/"), -1).alias("name"), number.alias("line_no"), "line")
    return named.filter(F.rlike("line", F.lit(r"(?U)\S")))


def described_lines(lines: DataFrame, **declared: str | int | None) -> DataFrame:
    """``lines`` with the columns of a described source; ``declared`` holds for all files."""
    fixed = {**DEFAULTS, **declared}
    types = {"offset_seconds": "int"}
    rows = lines.withColumns({c: F.lit(v).cast(types.get(c, "string")) for c, v in fixed.items()})
    return resolved_service(rows.withColumn("file_idx", F.xxhash64("file_id")))
