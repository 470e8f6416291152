"""Pieces of text as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x01"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it; keeps plans and code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a pattern that spans all of ``text``, in one pass; null if it does not match."""
    joined = SEPARATOR.join(f"${i}" for i in range(1, n + 1))
    return let(
        F.translate(text, SEPARATOR, " "),
        lambda c: F.when(F.rlike(c, F.lit(pattern)), F.split(F.regexp_replace(c, pattern, joined), SEPARATOR, -1)),
    )


def strip(text: Column, chars: str = " \t\n\r\x0b\x0c") -> Column:
    return F.btrim(text, F.lit(chars))


def json_string(text: Column) -> Column:
    """The JSON text of a string; most need no escapes."""
    escaped = let(F.to_json(F.array(text)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return F.when(F.rlike(text, F.lit(r'["\\\x00-\x1f\x7f\u2028\u2029]')), escaped).when(text.isNotNull(), F.concat(F.lit('"'), text, F.lit('"')))


def json_plain(value: Column) -> Column:
    """The text of a JSON scalar: strings without quotes, other values as they are; null for JSON null."""

    def plain(v: Column) -> Column:
        quoted = F.startswith(v, F.lit('"'))
        bare = F.substr(v, F.lit(2), F.length(v) - 2)
        return F.when(quoted & ~F.contains(v, F.lit("\\")), bare).when(quoted, F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x")).when(v != "null", v)

    return let(value, plain)


def fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals, 4 at most, as C prints it: its exact value decides, and of two as near the even one.

    Java rounds the shortest text of a double half up instead. The value is the sum of a float and what that leaves, and
    both times a power of ten are exact; so is the comparison with one half. From 2^52 / 10^digits on Java prints.
    """

    def rounded(x: Column) -> Column:
        size = F.abs(x)
        high = size.cast("float").cast("double")
        whole = F.floor(size * 10**digits)
        above, rest = high * 10**digits - whole - 0.5, -(size - high) * 10**digits
        up = (above > rest) | (above == rest) & (whole % 2 == 1)
        n = (whole + F.when(up, 1).otherwise(0)).cast("bigint")

        def text(m: Column) -> Column:
            tail = F.concat(F.lit("."), F.lpad((m % 10**digits).cast("string"), digits, "0")) if digits else F.lit("")
            return F.concat(F.when(x < 0, "-").otherwise(""), ((m - m % 10**digits) / 10**digits).cast("bigint").cast("string"), tail)

        return F.when(size < 2.0**52 / 10**digits, let(n, text)).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))

    return let(value.cast("double"), rounded)


def file_stem(name: Column) -> Column:
    """The last part of a path less log suffixes, each taken off once, in this order; 'unknown' if nothing is left."""
    stem = F.element_at(F.split(name, "/"), -1)
    for suffix in (".log", ".txt", ".json", ".ndjson", ".jsonl", ".gz"):
        stem = F.regexp_replace(stem, rf"\{suffix}$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("unknown"))


def scalar_json(raw: Column) -> Column:
    """The JSON text of a bare token: booleans, nulls, integers and decimals typed, anything else a string."""
    def typed(r: Column) -> Column:
        number = F.regexp_replace(r, r"^\+", "")
        word = F.lower(r)
        return (
            F.when(
                F.rlike(r, F.lit(r"^[+-]?\d")),
                F.when(F.rlike(r, F.lit(r"^[+-]?\d{1,18}$")), number.try_cast("bigint").cast("string"))
                .when(F.rlike(r, F.lit(r"^[+-]?\d+\.?\d*(?:[eE][+-]?\d+)?$")), number.try_cast("double").cast("string"))
                .otherwise(json_string(r)),
            )
            .when(word.isin("true", "false"), word)
            .when(word.isin("null", "nil", "none"), F.lit("null"))
            .otherwise(json_string(r))
        )

    return let(raw, typed)


def present(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def map_of(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not null."""
    items = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(items, lambda x: x.value.isNotNull()))


NO_MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(NO_MAP)


def over(low: Column, high: Column) -> Column:
    """Two maps in one; on equal keys the second wins."""
    return let(high, lambda h: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(h, k)), h))
