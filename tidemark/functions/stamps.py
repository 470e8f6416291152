"""Timestamps as (ts, offset_s): local time without a zone, and seconds east of UTC or null where the text says none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import groups, let

STAMP = "struct<ts:timestamp_ntz,offset_s:int>"
NONE = "cast(null as struct<ts:timestamp_ntz,offset_s:int>)"

# The shapes of a stamp at the head of a line.
ISO = r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?)"
CLF = r"(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s*[+-]\d{4})"
SYSLOG = r"([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2})"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def none() -> Column:
    return F.expr(NONE)


def stamp(ts: Column, offset: Column) -> Column:
    return let(ts, lambda t: F.when(t.isNotNull(), F.struct(t.alias("ts"), offset.cast("int").alias("offset_s"))))


def offset_seconds(text: Column) -> Column:
    """Seconds of ``Z``, ``+05:30`` or ``+0530``; null for ''."""

    def seconds(d: Column) -> Column:
        size = F.substr(d, F.lit(2), F.lit(2)).try_cast("int") * 3600 + F.coalesce(F.substr(d, F.lit(4), F.lit(2)).try_cast("int"), F.lit(0)) * 60
        return F.when(d == "Z", F.lit(0)).when(F.startswith(d, F.lit("-")), -size).when(F.startswith(d, F.lit("+")), size)

    return let(F.translate(text, ":", ""), seconds)


def iso(text: Column) -> Column:
    """ISO 8601 date, or date and time with fraction and offset; fractions are cut to microseconds."""

    def made(g: Column) -> Column:
        clock = F.coalesce(F.nullif(g[1], F.lit("")), F.lit("00:00:00"))
        ts = F.concat(g[0], F.lit(" "), clock, F.lit("."), F.rpad(F.left(g[2], F.lit(6)), 6, "0")).try_cast("timestamp_ntz")
        return stamp(ts, offset_seconds(g[3]))

    return let(groups(text, rf"^\s*{ISO[:-1]})?\s*$", 4), made)


def clf(text: Column) -> Column:
    """``02/Mar/2025:09:10:11 +0000``."""

    def made(g: Column) -> Column:
        day = F.concat_ws("-", g[2], month(g[1]), F.lpad(g[0], 2, "0"))
        return stamp(F.concat(day, F.lit(" "), g[3]).try_cast("timestamp_ntz"), offset_seconds(g[4]))

    return let(groups(text, r"^\s*(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{2}:\d{2}:\d{2})\s*([+-]\d{4})\s*$", 5), made)


def month(name: Column) -> Column:
    """Two digits; 00 for what is not a month."""
    return F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string"), 2, "0")


def syslog(text: Column, year: Column) -> Column:
    """``Mar  2 09:10:11`` in ``year``, without a zone."""

    def made(g: Column) -> Column:
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month(g[0]), F.lpad(g[1], 2, "0"))
        return F.when(year > 0, stamp(F.concat(day, F.lit(" "), g[2]).try_cast("timestamp_ntz"), F.lit(None)))

    return let(groups(text, r"^([A-Za-z]{3})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2})$", 3), made)


def epoch(value: Column) -> Column:
    """Seconds, or milli-, micro- or nanoseconds by magnitude, in UTC."""

    def micros(x: Column) -> Column:
        size = F.abs(x)
        return F.floor(F.when(size >= 10**17, x / 1000).when(size >= 10**14, x).when(size >= 10**11, x * 1000).otherwise(x * 1_000_000)).try_cast("bigint")

    def made(m: Column) -> Column:
        return F.when(F.abs(m) < 250_000_000_000_000_000, F.timestamp_add("MICROSECOND", m, F.expr("timestamp_ntz '1970-01-01 00:00:00'")))

    return stamp(let(let(value.try_cast("decimal(38,9)"), micros), made), F.lit(0))


def of_json(value: Column, plain: Column) -> Column:
    """A JSON value: numbers and digit strings as epochs, other strings as ISO 8601; ``plain`` is its text."""
    quoted = F.startswith(value, F.lit('"'))
    return let(
        F.btrim(plain, F.lit(" \t")),
        lambda t: F.when(F.rlike(t, F.lit(r"^\d+$")) | ~quoted & F.rlike(t, F.lit(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), epoch(t)).when(quoted, iso(t)),
    )


def leading(text: Column, year: Column) -> Column:
    """(found, rest): the stamp within the first 64 characters that opens ``text``, and the text after it."""
    forms = [(rf"^.?{ISO}", iso, r"^\D"), (rf"^.*?{CLF}", clf, r"^.*?(?=\d{2}/[A-Za-z]{3}/)"), (rf"^.?{SYSLOG}", lambda x: syslog(x, year), r"^[^A-Z]|^[A-Z](?=[A-Z])")]

    def attempt(t: Column, pattern: str, read: Callable, before: str, otherwise: Column) -> Column:
        def opened(m: Column) -> Column:
            rest = F.ltrim(F.substr(t, F.length(m) + 1), F.lit(" \t:|-"))
            stamped = F.when(m != "", read(F.regexp_replace(m, before, "")))
            return let(stamped, lambda s: F.when(s.isNotNull(), F.struct(s.alias("found"), rest.alias("rest"))).otherwise(otherwise))

        return let(F.regexp_extract(F.left(t, F.lit(64)), pattern, 0), opened)

    def made(t: Column) -> Column:
        out = F.struct(none().alias("found"), t.alias("rest"))
        for pattern, read, before in reversed(forms):
            out = attempt(t, pattern, read, before, out)
        return out

    return let(text, made)
