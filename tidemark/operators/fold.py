"""Lines to events: which line starts an event, and the lines that continue it.

Files of a batch are bounded by the upload limit and are folded by a window each (``fold``). Files of any size are folded
in blocks of lines (``fold_blocks``): each block finds its own starts, the open event at its end is carried into the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.formats import ADDED
from tidemark.operators import scan
from tidemark.schema import FORMATS, MAX_CONTINUATIONS, MAX_LINE_CHARS
from tidemark.sources.files import lines_of

# What a line of each format looks like.
CONTINUATION = r"""^(?:\s+|Caused by:|Traceback \(most recent call last\)|\.{3}\s*\d*\s*more|at\s+[\w$.<>]+\(|File ")"""
CLF_LINE = r'(?s)^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(.*)$'
POSTGRES_LINE = (
    r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?)(?:\s+([A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?))?\s*\[(\d+)(?:-(\d+))?\]\s*(.*?)"
    r"(LOG|ERROR|FATAL|PANIC|WARNING|NOTICE|DEBUG[1-5]?|INFO|STATEMENT|DETAIL|HINT|CONTEXT|QUERY):\s*(.*)$"
)
POSTGRES_PREFIX = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s+\S+)?\s*\[\d+"
SUBORDINATE = ["STATEMENT", "DETAIL", "HINT", "CONTEXT", "QUERY"]
SYSLOG5424_LINE = r"(?s)^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (.*)$"
SYSLOG_LINE = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: ?(.*)$"
CRI_LINE = r"(?s)^(\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:\d{2}))\s+(stdout|stderr)\s+([FP])\s(.*)$"
LOGFMT_PAIR = r"""([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s]*)"""

# Marks of what is left out of a line and of an event.
LINE_MARK = " …[line truncated]"
CAP_MARK = f"…[{MAX_CONTINUATIONS}-line continuation cap reached]"

CONTEXT = ["file_id", "file_idx", "service", "service_declared", "role", "format", "flavor"]


def is_continuation(line: Column) -> Column:
    return F.rlike(line, F.lit(CONTINUATION))


def starts_event(formats: set[str]) -> Column:
    """Whether ``line`` starts an event of a file of ``format``; ``previous`` is the line before it."""
    line, fmt = F.col("line"), F.col("format")
    own = ~is_continuation(line)
    part = lambda text, i: F.regexp_extract(text, CRI_LINE, i)
    rules = {
        "json": lambda: F.lit(True),
        "cri": lambda: (part(line, 3) == "") | (part("previous", 3) != "P") | (part("previous", 2) != part(line, 2)),
        "logfmt": lambda: own & F.rlike(line, F.lit(LOGFMT_PAIR)),
        "clf": lambda: own | F.rlike(line, F.lit(CLF_LINE)),
        "postgres": lambda: F.when(F.rlike(line, F.lit(POSTGRES_LINE)), ~F.regexp_extract(line, POSTGRES_LINE, 6).isin(*SUBORDINATE)).otherwise(own | F.rlike(line, F.lit(POSTGRES_PREFIX))),
        "syslog5424": lambda: own | F.rlike(line, F.lit(SYSLOG5424_LINE)),
        "syslog": lambda: own | F.rlike(line, F.lit(SYSLOG_LINE)),
    }
    for name, added in ADDED.items():
        rules[name] = lambda pattern=added.line: own | F.rlike(line, F.lit(pattern))
    starts = own
    for name, rule in rules.items():
        if name in formats:
            starts = F.when(fmt == name, rule()).otherwise(starts)
    return starts


def fold(sources: DataFrame, formats: Iterable[str] = FORMATS) -> DataFrame:
    """(CONTEXT, line_no, line, extra, raw) per event of described sources with format and flavor."""
    return fold_lines(lines_of(sources, *CONTEXT), formats)


def _clamped(lines: DataFrame) -> DataFrame:
    whole = F.col("format").isin("json", "cri") | (F.length("line") <= MAX_LINE_CHARS)
    return lines.withColumn("line", F.when(whole, F.col("line")).otherwise(F.concat(F.left("line", F.lit(MAX_LINE_CHARS)), F.lit(LINE_MARK))))


def _packed(lines: DataFrame) -> DataFrame:
    """Events of ``lines`` that name their ``event``."""
    events = lines.groupBy(*CONTEXT, "event").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    rest = F.transform(F.slice("all", 2, MAX_CONTINUATIONS), lambda x: x.line)
    marked = F.when(F.size("all") > MAX_CONTINUATIONS + 1, F.concat(rest, F.array(F.lit(CAP_MARK)))).otherwise(rest)
    folded = events.select(*CONTEXT, F.col("all")[0]["line_no"].alias("line_no"), F.col("all")[0]["line"].alias("line"), F.when(F.col("format") == "cri", F.transform(F.slice("all", 2, 1 << 30), lambda x: x.line)).otherwise(marked).alias("extra"))
    return folded.withColumn("raw", F.when(F.size("extra") > 0, F.concat("line", F.lit("\n"), F.array_join("extra", "\n"))).otherwise(F.col("line")))


def fold_lines(lines: DataFrame, formats: Iterable[str] = FORMATS) -> DataFrame:
    """Events of ``lines`` (CONTEXT, line_no, line) of files that one task can hold.

    Every line of a JSON file is an event, so where all files are JSON nothing is gathered.
    """
    if set(formats) == {"json"}:
        return _clamped(lines).select(*CONTEXT, "line_no", "line", F.array().cast("array<string>").alias("extra"), F.col("line").alias("raw"))
    in_file = Window.partitionBy("file_idx").orderBy("line_no")
    lines = _clamped(lines).withColumn("previous", F.lag("line").over(in_file))
    lines = lines.withColumn("start", F.col("previous").isNull() | starts_event(set(formats)))
    return _packed(lines.withColumn("event", F.sum(F.col("start").cast("int")).over(in_file)))


#: Names of a file in windows and joins; the number alone may be a hash.
FILE = ["file_id", "file_idx"]


def fold_blocks(lines: DataFrame, formats: Iterable[str] = FORMATS, shifts: Sequence[int] = scan.LINES) -> DataFrame:
    """The same events for files of any size; no task holds more than a block of lines or an event.

    An event is named by its first line; lines before the first start of a file are an event as well. Of the lines that
    continue an event no more are gathered than it keeps, so an event of very many lines is not gathered in one task.
    """
    lines = _clamped(lines)
    if "cri" in formats:
        lines = scan.before(lines, FILE, "line_no", {"previous": (F.col("line"), "last")}, shifts=shifts)
        start = F.col("previous").isNull() | starts_event(set(formats))
    else:
        start = starts_event(set(formats))
    return gather_blocks(lines.withColumn("start", start), shifts)


def kept(lines: DataFrame, *event: str) -> DataFrame:
    """Of the lines of each ``event`` no more than it keeps; all fragments of a CRI line."""
    piece = F.when(F.col("format") == "cri", F.col("line_no"))
    rank = F.row_number().over(Window.partitionBy(*FILE, *event, piece).orderBy("line_no"))
    return lines.withColumn("rank", rank).filter(F.col("rank") <= MAX_CONTINUATIONS + 2)


def gather_blocks(lines: DataFrame, shifts: Sequence[int] = scan.LINES) -> DataFrame:
    """Events of ``lines`` that say whether they ``start`` one."""
    lines = lines.withColumn("own", F.when(F.col("start"), F.col("line_no")))
    lines = scan.before(lines, FILE, "line_no", {"open": (F.col("own"), "last")}, shifts=shifts)
    return _packed(kept(lines.withColumn("event", F.coalesce("own", "open", F.lit(0))), "event"))
