"""Sources of log text: rows of (file_idx, name, content, service, role, format, timezone, offset_seconds)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.formats import known
from tidemark.functions.text import file_stem, let
from tidemark.schema import MAX_FILE_BYTES, MAX_FILES, ROLES, SOURCE

DEFAULTS = {"service": None, "role": "unknown", "format": None, "timezone": None, "offset_seconds": 0}


class TooManyFiles(ValueError):
    """More files than one batch may hold."""


def file_set(spark: SparkSession, files: Iterable[dict]) -> DataFrame:
    """A batch from dicts with name and content and, optionally, the other columns."""
    rows = [{**DEFAULTS, **f, "file_idx": i} for i, f in enumerate(files)]
    if len(rows) > MAX_FILES:
        raise TooManyFiles(f"{len(rows)} files; a batch has at most {MAX_FILES}")
    for r in rows:
        if r["format"] and r["format"] not in known():
            raise ValueError(f"unknown format {r['format']!r}")
        if abs(r["offset_seconds"] or 0) > 86_400 or not 1 <= len(r["name"]) <= 255:
            raise ValueError(f"offset or name of {r['name']!r} out of range")
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SOURCE.split(", ")) for r in rows], SOURCE)


def pasted(spark: SparkSession, text: str) -> DataFrame:
    return file_set(spark, [{"name": "pasted", "content": text}])


def uploaded(spark: SparkSession, path: str, sidecar: DataFrame | None = None) -> DataFrame:
    """Files below ``path`` as UTF-8 with U+FFFD for invalid bytes, in order of name; larger ones than the limit raise.

    ``sidecar``: (name, service, role, format, timezone, offset_seconds), matched by file name; of several rows of one
    name the last by ``position``, if it has that column, wins.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")
    checked = raw.withColumn("content", F.when(F.col("length") > MAX_FILE_BYTES, F.raise_error(F.concat(F.lit("file above the size limit: "), F.col("name")))).otherwise(F.col("content")))
    names = raw.select("name").orderBy("name").limit(MAX_FILES + 1).collect()  # a batch has few files
    if len(names) > MAX_FILES:
        raise TooManyFiles(f"a batch has at most {MAX_FILES} files")
    order = F.array_position(F.array(*[F.lit(r.name) for r in names]), F.col("name")).cast("int") - 1 if names else F.lit(0)
    files = checked.select(order.alias("file_idx"), "name", F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "UTF-8"), "UTF-8").alias("content"))
    if sidecar is None:
        extra = {c: F.lit(v).cast("int" if c == "offset_seconds" else "string") for c, v in DEFAULTS.items()}
        return files.withColumns(extra)
    position = "position" if "position" in sidecar.columns else "name"
    last = sidecar.groupBy("name").agg(*[F.max_by(c, position).alias(c) for c in DEFAULTS])
    return files.join(last, "name", "left").select(
        "file_idx", "name", "content", "service", F.coalesce("role", F.lit("unknown")).alias("role"), "format", "timezone", F.coalesce("offset_seconds", F.lit(0)).alias("offset_seconds")
    )


def truncated(content: Column, limit: int) -> Column:
    """``content`` cut to ``limit`` bytes of UTF-8; a character that the cut breaks goes."""
    cut = F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(content) > limit, F.regexp_replace(cut, "\uFFFD+$", "")).otherwise(content)


def described(sources: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``sources`` with file_id, the resolved service, whether it was declared, and content within the limit."""
    named = resolved_service(sources.withColumn("file_id", F.concat(F.lit("f"), F.col("file_idx"))))
    return named.withColumn("content", truncated(F.coalesce("content", F.lit("")), max_bytes))


def resolved_service(sources: DataFrame) -> DataFrame:
    """``sources`` with the declared service or the stem of the name, whether it was declared, and a known role."""
    declared = F.coalesce(F.col("service"), F.lit("")) != ""
    return sources.withColumns(
        {
            "service_declared": declared,
            "service": F.when(declared, F.col("service")).otherwise(file_stem(F.col("name"))),
            "role": F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("unknown"),
        }
    )


#: Line ends: CR LF and every single character that ends a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(sources: DataFrame, *keep: str, first: int | None = None) -> DataFrame:
    """(keep, line_no, line) of the non-blank lines; numbers count from 1 and count blank lines.

    ``first``: the first ones of each source only, numbered without blank lines.
    """
    filled = lambda pieces: F.filter(pieces, lambda x: F.rlike(x, F.lit(r"(?U)\S")))
    pieces = F.split("content", LINE_ENDS, -1)
    if first is not None:  # mostly the head of a text has them, so that the rest of it stays whole
        head = filled(F.slice(F.split("content", LINE_ENDS, 2 * first + 1), 1, 2 * first))
        whole = filled(pieces)
        pieces = let(head, lambda h: F.slice(F.when(F.size(h) >= first, h).otherwise(whole), 1, first))
    pieces = sources.select(*keep, F.posexplode_outer(pieces).alias("pos", "line"))  # a plain one would split the text for a filter first
    return pieces.select(*keep, (F.col("pos") + 1).alias("line_no"), "line").filter(F.rlike("line", F.lit(r"(?U)\S")))
