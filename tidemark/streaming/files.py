"""Growing files as a stream, in any of the formats: lines to events to dated entries, with a small state per file.

There are two ways. ``append_entries`` goes through a trigger's lines in blocks (``scan``), however many lines a file has
in it, and appends entries to a folder. ``entries_stream`` is a plan with stateful steps and timeouts for triggers that the
source bounds: a trigger's lines of a file meet in one Python worker.

What a line is by itself (whether it can start an event, which fragment of a CRI line it is) is worked out by column
functions before the state; the state of a file holds its open event, the number of its last line and its last stamp. Streams of stateful steps are started
within ``state_store(spark)``, which names the store that chained stateful steps need:

    with files.state_store(spark):
        files.entries_stream(lines, 2024).writeStream ... .start()
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators import fold, normalize, parse, scan
from tidemark.schema import FORMATS, MAX_CONTINUATIONS

CONTEXT_TYPES = "file_id string, file_idx long, service string, service_declared boolean, role string, format string, flavor string"
#: Settings of the store of states: what a trigger changed is written, not all of the state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What ``append_entries`` knows of a file after a trigger: its last line's number, its last stamp, the lines of its open event.
KNOWN = "file_id string, file_idx long, context struct<service: string, service_declared: boolean, role: string, format: string, flavor: string>, last_no long, stamp timestamp_ntz, open array<struct<line_no: long, line: string>>"
OPEN = "last_no long, line_no long, line string, extra array<string>, fragment string, channel string"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within it keep their states as ``STORE`` says; the session's settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Folded(StatefulProcessor):
    """Events of a file; the state is its open event and what is known of its last line."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, at, line, extra, fragment, channel = self.open.get() or (-1, 0, None, [], None, None)
        new = pd.concat(list(rows), ignore_index=True).sort_values("line_no", kind="stable")
        new = new[new["line_no"] > last].drop_duplicates("line_no")
        if not len(new):
            return
        cri = key[fold.CONTEXT.index("format")] == "cri"
        numbers, texts = new["line_no"].to_numpy(), new["line"].to_numpy(object)
        ends = pd.isna(texts)
        starts = new["own"].to_numpy(bool) | ends
        starts[1:] |= ends[:-1]
        starts[0] |= line is None
        if cri:
            parts, ways = new["fragment"].to_numpy(object), new["channel"].to_numpy(object)
            starts |= (np.append([fragment], parts[:-1]) != "P") | (np.append([channel], ways[:-1]) != ways)
            fragment, channel = parts[-1], ways[-1]
        cuts = [*np.flatnonzero(starts), len(texts)]
        extra, out = self.capped([*extra, *texts[: cuts[0]]], cri), []
        for head, end in zip(cuts, cuts[1:]):
            if line is not None:
                out.append((*key, at, line, extra))
            at, line = int(numbers[head]), None if ends[head] else texts[head]
            extra = self.capped(list(texts[head + 1 : end]), cri)
        self.open.update((int(numbers[-1]), at, line, extra, fragment, channel))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if line is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self.events(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, at, line, extra, _, _ = self.open.get()
        self.open.update((last, 0, None, [], None, None))
        yield self.events([(*key, at, line, list(extra))] if line is not None else [])

    def capped(self, extra: list[str], whole: bool) -> list[str]:
        """What an event keeps of its further lines; all fragments of a CRI line."""
        return extra if whole or len(extra) <= MAX_CONTINUATIONS else [*extra[:MAX_CONTINUATIONS], fold.CAP_MARK]

    def events(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*fold.CONTEXT, "line_no", "line", "extra"])


def _arriving(lines: DataFrame) -> DataFrame:
    kept = lines.select(*fold.CONTEXT, F.col("line_no").cast("long").alias("line_no"), "line").filter("line is null or line rlike r'(?U)\\S'")
    return fold._clamped(kept).withColumn("file_idx", F.col("file_idx").cast("long"))


def _marked(lines: DataFrame, formats: Iterable[str]) -> DataFrame:
    """``lines`` with what each is by itself: fragment and channel of a CRI line, and whether it starts an event (own)."""
    cri = F.col("format") == "cri"
    part = lambda i: F.when(cri, F.regexp_extract("line", fold.CRI_LINE, i))
    own = fold.starts_event(set(formats) - {"cri"})
    return lines.withColumns({"fragment": part(3), "channel": part(2)}).withColumn("own", F.coalesce(F.when(cri, F.col("fragment") == "").otherwise(own), F.lit(True)))


def fold_stream(lines: DataFrame, formats: Iterable[str] = FORMATS, timeout_ms: int | None = 30_000) -> DataFrame:
    """(CONTEXT, line_no, line, extra, raw) per event of a stream of (CONTEXT, line_no, line), as ``fold.fold`` gives them.

    A file's lines come in order from one trigger to the next, in any order within a trigger. A line whose number is not
    above the last one seen was delivered again and does not count, so a source may repeat itself. An event is emitted
    when a line starts the next one, when a row whose line is null says that the file ends, or after ``timeout_ms``
    without new lines (None: never); lines that continue an event after its timeout are an event of their own. A trigger's
    lines of one file are one task's, so the source bounds them (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). Blank
    lines are passed over.
    """
    rows = _marked(_arriving(lines), formats).groupBy(*fold.CONTEXT)
    shape = f"{CONTEXT_TYPES}, line_no long, line string, extra array<string>"
    events = rows.transformWithStateInPandas(Folded(timeout_ms), shape, "append", "None" if timeout_ms is None else "ProcessingTime")
    return events.withColumn("raw", F.when(F.size("extra") > 0, F.concat("line", F.lit("\n"), F.array_join("extra", "\n"))).otherwise(F.col("line")))


class Carried(StatefulProcessor):
    """Entries of a file with the last stamp before them; the state is that stamp."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamp = handle.getValueState("stamp", "stamp string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.stamp.get()
        new = pd.concat(list(rows), ignore_index=True).sort_values(["line_no", "seq"], kind="stable")
        carry = new["own"].astype(object).ffill()
        carry = carry.where(carry.notna(), before[0] if before else None)
        if pd.notna(carry.iloc[-1]):
            self.stamp.update((carry.iloc[-1],))
        yield new.assign(carry=carry)[[*self.names, "carry"]]


def date_stream(entries: DataFrame) -> DataFrame:
    """``normalize.resolve`` over a stream of parsed entries: those without a stamp carry the last one of their file.

    What comes after an entry is not known yet, so entries at the head of a file without a stamp stay undated
    (time_source 'none'), where a batch gives them the earliest stamp of the file. Entries of a file come in order from
    one trigger to the next.
    """
    read = normalize.own_stamps(entries).withColumn("own", F.col("own").cast("string"))
    shape = StructType([StructField(f.name, f.dataType, True) for f in read.schema.fields] + [StructField("carry", StringType())])
    dated = read.groupBy("file_id", "file_idx").transformWithStateInPandas(Carried(read.columns), shape, "append", "None")
    return _dated(dated, F.col("carry").cast("timestamp_ntz"), F.col("own").cast("timestamp_ntz"))


def _dated(entries: DataFrame, at: Column, own: Column) -> DataFrame:
    source = F.coalesce("own_source", F.when(at.isNotNull(), "carried").otherwise("none"))
    return entries.withColumn("timestamp", at).withColumn("time_source", source).withColumn("read_at", own).drop("own", "own_source", "ts", "offset_s", "carry")


def entries_stream(lines: DataFrame, year: int, formats: Iterable[str] = FORMATS, timeout_ms: int | None = 30_000, timezone: str | None = None, offset_seconds: int = 0) -> DataFrame:
    """Dated entries of a stream of lines: fold, parse and date in one plan."""
    formats = list(formats)
    made = parse.parse_events(fold_stream(lines, formats, timeout_ms), year, formats)
    return date_stream(made.withColumns({"timezone": F.lit(timezone).cast("string"), "offset_seconds": F.lit(offset_seconds)}))


def append_entries(
    lines: DataFrame, folder: str, year: int, formats: Iterable[str] = FORMATS, timezone: str | None = None, offset_seconds: int = 0, shifts: Sequence[int] = scan.LINES
) -> DataStreamWriter:
    """A writer that appends to ``folder`` what ``entries_stream`` without timeouts gives; ``appended`` reads it.

    A trigger's lines are folded, parsed and dated as tables in blocks of lines, so it may bring any number of lines of a
    file: no task holds more than a block or an event, and nothing leaves the JVM. What is known of the files is a table
    that each trigger writes anew from the one before. A trigger that is run again overwrites what it had written.
    """
    spark, formats = lines.sparkSession, list(formats)
    zones = {"timezone": F.lit(timezone).cast("string"), "offset_seconds": F.lit(offset_seconds)}

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def step(arrived: DataFrame, number: int) -> None:
        if number == 0:
            stored(spark.range(0).select(F.from_json(F.lit("{}"), KNOWN).alias("file")).select("file.*"), "known/-1")
        known = spark.read.schema(KNOWN).parquet(f"{folder}/known/{number - 1}")
        marks = lambda rows: _marked(rows, formats).withColumn("ends", F.col("line").isNull())
        new = stored(marks(_arriving(arrived)), "work/lines").join(known.select(*fold.FILE, "last_no"), fold.FILE, "left").filter("last_no is null or line_no > last_no").drop("last_no")
        rows = new.unionByName(marks(known.select(*fold.FILE, "context.*", F.inline("open"))))
        started = _started(rows, shifts)
        context = F.struct(*[c for c in fold.CONTEXT if c not in fold.FILE]).alias("context")
        heads = stored(started.groupBy(*fold.FILE).agg(F.first(context).alias("context"), F.max("line_no").alias("last_no"), F.max(F.when(F.col("start"), F.col("line_no"))).alias("newest")), "work/heads")
        newest = heads.select(*fold.FILE, "newest")
        told = started.join(newest, fold.FILE).filter("not ends")
        events = fold.gather_blocks(told.filter("line_no < newest").select(*fold.CONTEXT, "line_no", "line", "start"), shifts)
        undated = stored(normalize.own_stamps(parse.parse_events(events, year, formats).withColumns(zones)), "work/undated")

        carried = scan.before(undated, fold.FILE, "line_no", {"carry": (F.col("own"), "last")}, order=["seq"], shifts=shifts)
        at = F.coalesce("own", "carry", "stamp")
        stored(_dated(carried.join(known.select(*fold.FILE, "stamp"), fold.FILE, "left"), at, F.col("own")).drop("stamp"), f"entries/trigger={number}")

        still = rows.join(newest, fold.FILE).filter("line_no >= newest and not ends").dropDuplicates([*fold.FILE, "line_no"])
        opens = fold.kept(still).groupBy(*fold.FILE).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("open"))
        stamps = undated.groupBy(*fold.FILE).agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.struct("line_no", "seq"))).alias("stamp"))
        parts = [known.drop("open").withColumn("age", F.lit(0)), heads.drop("newest"), stamps.withColumn("age", F.lit(1)), opens]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part, allowMissingColumns=True)
        latest = F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("age")))
        first = lambda c: F.first(c, ignorenulls=True).alias(c)
        stored(union.groupBy(*fold.FILE).agg(first("context"), F.max("last_no").alias("last_no"), latest.alias("stamp"), first("open")), f"known/{number}")

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/marks")


def _started(rows: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """``rows`` without lines that are there twice, and whether each starts an event."""
    told = F.struct("line_no", "fragment", "channel", "ends")
    rows = scan.before(rows, fold.FILE, "line_no", {"previous": (told, "last")}, shifts=shifts).filter("previous is null or previous.line_no < line_no")
    apart = (F.col("format") == "cri") & ~(F.col("previous.fragment").eqNullSafe("P") & F.col("previous.channel").eqNullSafe(F.col("channel")))
    return rows.withColumn("start", F.col("own") | F.col("previous").isNull() | F.coalesce("previous.ends", F.lit(False)) | apart)


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that ``append_entries`` has written to ``folder``."""
    return spark.read.parquet(f"{folder}/entries").drop("trigger")
