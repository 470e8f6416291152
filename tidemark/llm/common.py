"""Helpers that the corpus operators share: scratch tables, readers and text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII blanks: space and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r "
#: A run of anything but ASCII blanks.
TOKEN = r"[^\x20\x09-\x0D]+"
#: What stands between words of digits, lower-case ASCII letters and non-ASCII characters, A-Z being lower-cased or not.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


#: While a work table is written: what was shuffled for it goes at once instead of whenever the driver collects garbage,
#: and Python workers get few texts at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Within it the settings of WRITING hold."""
    before = {name: spark.conf.get(name, None) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def work_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage (a lost executor rereads the files instead of recomputing) and gives every later use of the
    table the same rows. What was shuffled for it is not needed after that.
    """
    path = scratch_path(df.sparkSession, label)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What one of the many broadcasts of a query may weigh; the driver holds several at once.
MAX_BROADCAST_BYTES = 16 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` for a broadcast if its counted rows of ``row_bytes`` allow that, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def token_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(TOKEN)).cast("long")


def words_of(text: Column) -> Column:
    """Words of digits, ASCII letters and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def word_count(text: Column) -> Column:
    """The number of words_of(text)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), ANY_CASE_GAP, -1), "")).cast("long")
