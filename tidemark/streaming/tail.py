"""Lines as a stream: stateful folding per file and level counts over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import levels, stamps
from tidemark.operators.fold import CAP_MARK, CONTINUATION
from tidemark.schema import MAX_CONTINUATIONS

EVENT = "name string, line_no long, line string, extra array<string>"
STATE = "next_no long, line_no long, line string, extra array<string>"


def fold_stream(lines: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """EVENT rows from a stream of (name, line): continuation lines join the event before them.

    The open event of a file and the number of its last line are its state; the event is emitted by the line that
    follows it, or after ``timeout_ms`` without new lines. Lines beyond the cap of an event leave one mark.
    """
    import re

    continues = re.compile(CONTINUATION)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, at, open_line, extra = state.get if state.exists else (0, 0, None, [])
        extra, out = list(extra), []
        if state.hasTimedOut:
            state.update((number, 0, None, []))  # lines to come count on
            yield pd.DataFrame({"name": [key[0]], "line_no": [at], "line": [open_line], "extra": [extra]})
            return
        for batch in batches:
            for line in batch["line"]:
                number += 1
                if not line or not line.strip():
                    continue
                if open_line is not None and continues.match(line):
                    if len(extra) <= MAX_CONTINUATIONS:
                        extra.append(line if len(extra) < MAX_CONTINUATIONS else CAP_MARK)
                    continue
                if open_line is not None:
                    out.append((key[0], at, open_line, extra))
                at, open_line, extra = number, line, []
        state.update((number, at, open_line, extra))
        if open_line is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["name", "line_no", "line", "extra"])

    return lines.groupBy("name").applyInPandasWithState(step, EVENT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stamped(lines: DataFrame, line: str = "line", year: int = 0) -> DataFrame:
    """A stream of lines with event time (UTC), level and the text after the stamp."""
    lead = stamps.leading(F.col(line), F.lit(year))
    rows = lines.withColumn("lead", lead)
    utc = F.timestamp_add("SECOND", -F.coalesce("lead.found.offset_s", F.lit(0)), F.col("lead.found.ts")).cast("timestamp")
    level = F.coalesce(levels.of_word(levels.first_word(F.left("lead.rest", F.lit(80)))), F.lit("info"))
    return rows.withColumn("event_time", utc).withColumn("level", level).withColumn("text", F.col("lead.rest")).drop("lead")


def level_counts(lines: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, level, n) per window of event time; lines later than ``late`` no longer count."""
    rows = stamped(lines).filter("event_time is not null").withWatermark("event_time", late)
    counted = rows.groupBy(F.window("event_time", every), "level").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "level", "n")
