"""detect, parse, budget, normalize, redact and report as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detect as detection
from tidemark.operators import fold, normalize, parse, redact, report, scan
from tidemark.schema import DETECT_LINES, ENTRY_COLUMNS, MAX_ENTRIES, MAX_FILE_BYTES, PASTE_BYTES, PASTE_ENTRIES
from tidemark.sources.bulk import described_lines, files_below, lines_below
from tidemark.sources.files import described, pasted, resolved_service
from tidemark.stored import light, settled, tabled


class Results:
    """What follows from ``entries``, which are redacted and unsorted, and from the report of ``files``."""

    entries: DataFrame
    files: DataFrame

    @property
    def timeline(self) -> DataFrame:
        return normalize.timeline(self.entries)

    @property
    def coverage(self) -> DataFrame:
        return report.coverage(self.entries)

    @property
    def totals(self) -> DataFrame:
        return report.batch_totals(self.files)

    def preview(self, n: int = 100) -> DataFrame:
        return report.preview(self.entries, n)


@dataclass(frozen=True)
class Ingested(Results):
    """Lazy results of a batch."""

    entries: DataFrame
    files: DataFrame
    redactions: DataFrame


@dataclass(frozen=True)
class Folder(Results):
    """Lazy results of a folder. ``files`` has a row a file and is stored when it is first asked for."""

    entries: DataFrame
    sizes: DataFrame
    detected: DataFrame
    counted: DataFrame

    @cached_property
    def files(self) -> DataFrame:
        counted = settled(self.counted)
        clocks = normalize.skew_of_many(counted.select("file_idx", "file_id", "first", "last", "unresolved"))
        return settled(report.joined_report(self.sizes, self.detected, counted.drop("file_id").join(clocks.select("file_idx", "skew_warning"), "file_idx", "left")))

    @property
    def redactions(self) -> DataFrame:
        return redact.redaction_counts(self.entries)


def ingest(
    sources: DataFrame, *, policy: redact.Policy | None = None, max_entries: int | None = MAX_ENTRIES, max_bytes: int = MAX_FILE_BYTES, year: int | None = None
) -> Ingested:
    """``year`` is assumed where a format has none; by default the first year seen in the batch, else the current one.

    ``max_entries``: entries kept over the batch in order of files; None for no budget.
    """
    files = described(sources, max_bytes)
    spark = sources.sparkSession
    found = detection.detect(files)
    detected = spark.createDataFrame(found.collect(), found.schema)  # one short row per file of a bounded batch
    formats = {r.format for r in detected.select("format").distinct().collect()}
    if year is None:
        year = detection.reference_year(files) or spark.range(1).select(F.year(F.current_timestamp())).first()[0]
    context = files.drop("format").join(F.broadcast(detected.select("file_idx", "format", "flavor")), "file_idx")
    made = parse.parse(context, year, formats)
    kept = made if max_entries is None else normalize.within_budget(made, max_entries)
    zones = files.select("file_idx", "timezone", "offset_seconds")
    resolved = normalize.resolve(kept.join(F.broadcast(zones), "file_idx"))
    # One pass over the entries for clocks and counts.
    counted = resolved.groupBy("file_idx", "file_id").agg(*normalize.clock(), *report.counts(), F.count(F.lit(1)).alias("made"))
    if max_entries is not None:
        counted = counted.drop("made").join(made.groupBy("file_idx").agg(F.count(F.lit(1)).alias("made")), "file_idx", "full")
    counted = normalize.detect_skew(counted)
    clean = redact.redact_entries(resolved.withColumn("template_id", F.lit(None).cast("string")).withColumn("flow_id", F.lit(None).cast("string")), policy)
    return Ingested(clean.select(*ENTRY_COLUMNS, "redactions", "touched"), report.file_report(files, detected, counted), redact.redaction_counts(clean))


def ingest_folder(
    spark: SparkSession, path: str, *, policy: redact.Policy | None = None, year: int | None = None, shifts: Sequence[int] = scan.LINES, **declared: str | int | None
) -> Folder:
    """All files below ``path`` that are not empty, however many and large; formats and clocks are found file by file."""
    lines = lines_below(spark, path)
    role = F.lit(declared.get("role", "unknown"))
    counts = lines.groupBy("file_id").agg(F.max("line_no").alias("line_count"))
    listed = resolved_service(files_below(spark, path).withColumns({"service": F.lit(declared.get("service")).cast("string"), "role": role}))
    sizes = listed.join(counts, "file_id", "left").select(F.xxhash64("file_id").alias("file_idx"), "file_id", "name", "service", "role", "bytes", F.coalesce("line_count", F.lit(0)).alias("line_count"))
    return _in_blocks(described_lines(lines, **declared), sizes, policy, year, shifts, declared)


def ingest_lines(lines: DataFrame, *, policy: redact.Policy | None = None, year: int | None = None, shifts: Sequence[int] = scan.LINES, **declared: str | int | None) -> Folder:
    """The same of files of any size that come as ``lines`` (file_id, name, line_no, line) without blank ones.

    Bytes of a file are those of its lines, each with a line end.
    """
    known = described_lines(lines, **declared)
    sizes = known.groupBy("file_idx", "file_id", "name", "service", "role").agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("line_no").alias("line_count"))
    return _in_blocks(known, sizes, policy, year, shifts, declared)


def _in_blocks(lines: DataFrame, sizes: DataFrame, policy: redact.Policy | None, year: int | None, shifts: Sequence[int], declared: Mapping[str, str | int | None]) -> Folder:
    """Described ``lines``, folded and dated in blocks of lines, so a file is no task's own.

    Formats are kept in a table and joined, not listed on the driver, which hears only which formats and what year occur.
    """
    files = lines.select("file_idx", "format").distinct()
    detected = settled(detection.detect(files, lines.filter(F.coalesce("format", F.lit("")) == "")))  # a declared format is not looked for
    formats = {r.format for r in detected.select("format").distinct().collect()}
    if year is None:
        stamped = F.regexp_extract("line", r"(?U)^\s*([0-9]{4})", 1).try_cast("int").alias("year")
        seen = lines.filter(F.col("line_no") <= DETECT_LINES).select("file_id", "line_no", stamped).filter("year between 2000 and 2100")
        year = seen.agg(F.min_by("year", F.struct("file_id", "line_no"))).first()[0] or lines.sparkSession.range(1).select(F.year(F.current_timestamp())).first()[0]
    found = detected.select(F.col("file_idx").alias("_file"), F.col("format").alias("found"), "flavor")
    if light(found, "found", "flavor"):  # few files: their lines need not meet for it
        found = F.broadcast(found)
    known = lines.join(found, F.col("file_idx") == F.col("_file")).withColumn("format", F.col("found")).drop("_file", "found")
    made = tabled(parse.parse_events(fold.fold_blocks(known.select(*fold.CONTEXT, "line_no", "line"), formats, shifts), year, formats))  # dating goes through them twice
    zones = {c: F.lit(declared.get(c)).cast(t) for c, t in (("timezone", "string"), ("offset_seconds", "int"))}
    resolved = normalize.resolve(made.withColumns(zones), shifts)
    nothing = F.lit(None).cast("string")
    clean = redact.redact_entries(resolved.withColumns({"template_id": nothing, "flow_id": nothing}), policy)
    counted = resolved.groupBy("file_idx", "file_id").agg(*normalize.clock(), *report.counts(), F.count(F.lit(1)).alias("made"))
    return Folder(clean.select(*ENTRY_COLUMNS, "redactions", "touched"), sizes, detected, counted)


def ingest_text(spark: SparkSession, text: str, **options) -> Ingested:
    return ingest(pasted(spark, text), max_entries=PASTE_ENTRIES, max_bytes=PASTE_BYTES, **options)


def store(result: Ingested, path: str, pull_id: str) -> None:
    """Entries as Parquet partitioned by pull."""
    result.entries.drop("redactions", "touched").withColumn("pull_id", F.lit(pull_id)).write.mode("append").partitionBy("pull_id").parquet(path)


def stored(spark: SparkSession, path: str, pull_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("pull_id") == pull_id)
