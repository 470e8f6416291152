"""Severity words and numbers as levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Severity words by level, syslog severities 0 to 7, bands of four severity numbers.
WORDS = {
    "trace": "TRACE FINEST VERBOSE",
    "debug": "DEBUG FINE DBG",
    "info": "INFO INFORMATION INFORMATIONAL NOTICE LOG STATEMENT DETAIL CONTEXT HINT DEFAULT",
    "warn": "WARN WARNING",
    "error": "ERROR ERR SEVERE",
    "critical": "ALERT CRIT CRITICAL",
    "fatal": "EMERG EMERGENCY FATAL PANIC",
}
SYSLOG = ["fatal", "critical", "critical", "error", "warn", "info", "info", "debug"]
BANDS = ["trace", "debug", "info", "warn", "error", "fatal"]

_ALL = sorted((w for words in WORDS.values() for w in words.split()), key=len, reverse=True)
WORD_PATTERN = rf"(?iU)\b(?:{'|'.join(_ALL)})\b"


def of_word(word: Column) -> Column:
    """The level of a severity word, null for other words."""
    pairs = [F.lit(x) for name, words in WORDS.items() for w in words.split() for x in (w, name)]
    return F.element_at(F.create_map(*pairs), F.upper(F.btrim(word, F.lit(" \t\n\r\x0b\x0c"))))


def named(word: Column, default: str = "info") -> Column:
    return F.coalesce(of_word(word), F.lit(default))


def first_word(text: Column) -> Column:
    """The first severity word in ``text``, '' if there is none."""
    return F.regexp_extract(text, WORD_PATTERN, 0)


def of_priority(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SYSLOG]), F.pmod(priority.cast("int"), F.lit(8)) + 1)


def of_number(value: Column, bands_only: Column | None = None) -> Column:
    """Numbers up to 24 (any, where ``bands_only``) in bands of four; above, the scale of tens."""
    banded_only = F.lit(False) if bands_only is None else bands_only
    names = F.array(*[F.lit(x) for x in BANDS])

    def level(n: Column) -> Column:
        return (
            F.when(n.isNull() | (n <= 0), F.lit("info"))
            .when((n <= 24) | banded_only, F.element_at(names, F.floor((F.least(n, F.lit(24)) - 1) / 4).cast("int") + 1))
            .when(n >= 60, F.lit("fatal"))
            .when(n >= 50, F.lit("critical"))
            .when(n >= 40, F.lit("error"))
            .when(n >= 30, F.lit("warn"))
            .otherwise(F.lit("info"))
        )

    return let(value.try_cast("double").cast("bigint"), level)
