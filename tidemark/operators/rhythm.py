"""When templates occur: gaps, cadence, bursts, and which ones follow each other.

Additions over entries with a template. A template that holds most entries is no task's own: the time before each entry is
found by scans over blocks of time (``scan``), and everything else is an aggregate that is combined before it is shuffled.
Entries without a stamp or without a template do not count. Times are microseconds since 1970 in UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.stored import settled

KEY = ("service", "template_id")


def occurrences(entries: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, at) of entries with all of ``key`` and a ``timestamp``."""
    rows = entries.select(*key, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))
    return rows.filter(" and ".join(f"{c} is not null" for c in (*key, "at")))


def gaps(occurred: DataFrame, key: Sequence[str] = KEY, shifts: Sequence[int] = scan.MICROS) -> DataFrame:
    """``occurred`` (key, at) with the gap to the one before of the same key, null for the first."""
    rows = occurred.withColumn("_place", F.col("at") + F.lit(1 << 61))
    found = scan.before(rows, key, "_place", {"_was": (F.col("at"), "max")}, shifts=shifts)
    return found.select(*key, "at", (F.col("at") - F.col("_was")).alias("gap"))


def cadence(gapped: DataFrame, key: Sequence[str] = KEY, accuracy: int | None = None, shifts: Sequence[int] = scan.MICROS) -> DataFrame:
    """(key, n, first, last, shortest, p10, p50, p90, longest): how often each key occurs, by its ``gapped`` times.

    The quantiles are exact: the least gap that at least that share of the gaps does not exceed. Equal gaps are counted
    first, and the counts before each gap come from a scan over blocks of gaps, so no task sorts the gaps of a key. With
    an ``accuracy`` they come from a mergeable summary instead: their rank is off by at most n / ``accuracy``.
    """
    tenths = {"p10": 1, "p50": 5, "p90": 9}
    about = [F.percentile_approx("gap", t / 10, accuracy).alias(p) for p, t in tenths.items()] if accuracy else []
    told = gapped.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("gap").alias("shortest"), F.max("gap").alias("longest"), *about,
    )
    columns = [*key, "n", "first", "last", "shortest", *tenths, "longest"]
    if accuracy:
        return told.select(*columns)
    counted = settled(gapped.filter("gap is not null").groupBy(*key, "gap").agg(F.count(F.lit(1)).alias("_n")))
    ranked = scan.before(counted, key, "gap", {"_lower": (F.col("_n"), "sum")}, shifts=shifts)
    until = F.coalesce("_lower", F.lit(0)) + F.col("_n")
    quantiles = ranked.join(counted.groupBy(*key).agg(F.sum("_n").alias("_all")), list(key)).groupBy(*key).agg(*[F.min(F.when(until * 10 >= F.col("_all") * t, F.col("gap"))).alias(p) for p, t in tenths.items()])
    return told.join(quantiles, list(key), "left").select(*columns)


def bursts(gapped: DataFrame, quiet: int, least: int = 2, key: Sequence[str] = KEY, shifts: Sequence[int] = scan.MICROS) -> DataFrame:
    """(key, start, end, n): runs of at least ``least`` times of a key with no gap above ``quiet`` microseconds."""
    opens = F.when(F.col("gap").isNull() | (F.col("gap") > quiet), F.col("at"))
    rows = gapped.withColumns({"_place": F.col("at") + F.lit(1 << 61), "_own": opens, "_late": opens.isNull()})
    found = scan.before(rows, key, "_place", {"_open": (F.col("_own"), "max")}, order=["_late"], shifts=shifts)  # of equal times the one that opens comes first
    start = F.greatest("_own", "_open")
    runs = found.groupBy(*key, start.alias("start")).agg(F.max("at").alias("end"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least)


def _side(df: DataFrame, key: Sequence[str], mark: str) -> list[Column]:
    return [F.col(c).alias(f"{mark}_{c}") for c in key]


def followers(occurred: DataFrame, within: int, slot: int, unit: int, key: Sequence[str] = KEY) -> DataFrame:
    """(a_key, b_key, n, of, median_lag): how often another key comes within ``within`` microseconds after a key, and how soon.

    Of each key one occurrence counts in each ``slot``, its first, so a bucket of time holds a bounded number for each key
    whatever the entries. Each is put into its own and the next bucket of the length ``within``, joined with those of
    other keys in that bucket, and the exact lag decides. Of each key the soonest one counts. Lags are cut to whole
    ``unit``s, so that an exact median keeps at most within / unit numbers. ``of``: the occurrences of the first key.
    """
    times = occurred.groupBy(*key, F.floor(F.col("at") / slot).alias("_slot")).agg(F.min("at").alias("at"))
    bucket = F.floor(F.col("at") / within)
    a = times.select(*_side(times, key, "a"), F.col("at").alias("a_at"), F.explode(F.array(bucket, bucket + 1)).alias("_a"))
    b = times.select(*_side(times, key, "b"), F.col("at").alias("b_at"), bucket.alias("_b"))
    lag = F.col("b_at") - F.col("a_at")
    other = F.struct(*[f"a_{c}" for c in key]) != F.struct(*[f"b_{c}" for c in key])
    met = a.join(b, (F.col("_a") == F.col("_b")) & (lag > 0) & (lag <= within) & other)
    names = [f"{m}_{c}" for m in "ab" for c in key]
    soonest = met.groupBy(*names, "a_at").agg((F.floor(F.min(lag) / unit) * unit).alias("lag"))
    found = soonest.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.median("lag").alias("median_lag"))
    totals = times.groupBy(*_side(times, key, "t")).agg(F.count(F.lit(1)).alias("of"))
    same = [F.col(f"a_{c}") == F.col(f"t_{c}") for c in key]
    return found.join(totals, same).select(*names, "n", "of", "median_lag")
