"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws the exponential key ``-ln(u) / weight``, ``u`` being a hash of its identifier, so reruns agree and a
heavier row tends to come earlier. A source with target ``t`` and ``s`` words is taken ``floor(t / s)`` whole times;
the rest of its budget goes to the rows with the smallest keys, up to the row in which the running sum of words
crosses the budget, which is cut there.

The running sum never gathers a source in one task: keys fall into ``buckets`` fixed ranges, the sums of the ranges
give the range in which the budget ends, and only the rows of that range are sorted.

Sources are groups of a corpus, not keys of rows: their targets are computed over one row for each source, in one task
(10,000 sources are 1 MB). Rows may be as many as there are.

Cases: null text or zero words: size 0, never selected for words. Null source: a source of its own, last in order.
Null identifier: keyed as the empty string. Null or non-positive row weight: ``1e-9``. Rows of equal key, as those that
repeat an identifier, are in order of identifier and size; if the cut falls on equal ones they share the rest evenly.
Very long texts count whole and may be cut by the budget. Empty table: no rows. Other columns pass through, except
those named like the ones added (size, source_size, target, taken, copies); working columns carry the prefix ``_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import work_table

MAX_BROADCAST_BYTES = 8 << 20


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. ``share`` of all words is split by weight; a
    target stops at ``max_epochs`` times its source and the excess goes to the others by weight. In ascending order
    of limit to weight, the level all unlimited sources share is the largest of the levels met at each step.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("_mix_rank", F.row_number().over(by_name) - 1).withColumn(
        "_mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_mix_rank") % n + 1).cast("int"))
    )
    whole = Window.partitionBy()
    upward = Window.orderBy("_mix_ratio", "_mix_rank")
    return (
        ranked.withColumn("_mix_cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
        .withColumn("_mix_total", F.sum("source_size").over(whole).cast("double") * share)
        .withColumn("_mix_below", F.sum("_mix_cap").over(upward.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_mix_cap"))
        .withColumn("_mix_from", F.sum("_mix_weight").over(upward.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_mix_level", (F.col("_mix_total") - F.col("_mix_below")) / F.col("_mix_from"))
        .withColumn("target", F.least(F.col("_mix_cap"), F.col("_mix_weight") * F.max("_mix_level").over(whole)))
        .select(source, "source_size", "target")
    )


def mix_sources(
    df: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column,
    weight: Column,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    buckets: int = 4096,
    seed: str = "mix-1",
) -> DataFrame:
    """``df`` with size, source_size, target, taken (words, repeats counted) and copies (times the row is used)."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), ident)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    positive = F.when(weight > 0, weight).otherwise(F.lit(1e-9))
    rows = (
        df.withColumns({"_mix_size": size.cast("long"), "_mix_key": -F.log(draw) / positive, "_mix_id": ident})
        .withColumn("_mix_bucket", F.floor(F.col("_mix_key") / (1 + F.col("_mix_key")) * buckets).cast("int"))
        .drop("size", "source_size", "target", "taken", "copies")
        .withColumnRenamed("_mix_size", "size")
    )
    narrow = work_table(rows.select(F.col(source).alias("_mix_source"), "size", "_mix_key", "_mix_id", "_mix_bucket"), "mix-keys")

    per_bucket = narrow.groupBy("_mix_source", "_mix_bucket").agg(F.sum("size").alias("_mix_words"))
    sizes = per_bucket.groupBy("_mix_source").agg(F.sum("_mix_words").alias("source_size"))
    targets = source_targets(sizes, "_mix_source", weights, share, max_epochs)
    targets = (
        targets.withColumn("_mix_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_mix_budget", F.floor(F.col("target") - F.col("_mix_epochs") * F.col("source_size")).cast("long"))
    )
    targets = work_table(targets, "mix-targets")
    weighed = targets.agg(F.sum(F.coalesce(F.octet_length(F.col("_mix_source").cast("string")), F.lit(0)) + 256)).first()[0] or 0
    small = weighed <= MAX_BROADCAST_BYTES

    def of_source(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on, "left")

    t = targets.select(F.col("_mix_source").alias("_mix_s"), "_mix_budget")
    running = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        of_source(per_bucket.withColumn("_mix_before", F.sum("_mix_words").over(running) - F.col("_mix_words")), t, F.col("_mix_source").eqNullSafe(F.col("_mix_s")))
        .filter((F.col("_mix_before") <= F.col("_mix_budget")) & (F.col("_mix_budget") < F.col("_mix_before") + F.col("_mix_words")))
        .select(F.col("_mix_source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), (F.col("_mix_budget") - F.col("_mix_before")).alias("_mix_left"))
    )
    inside = (
        narrow.join(F.broadcast(last) if small else last, F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")))
        .groupBy("_mix_source", "_mix_left", "_mix_key", "_mix_id", "size")
        .agg(F.count(F.lit(1)).alias("_mix_rows"))
    )
    in_order = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("_mix_rows")
    cut = (
        inside.withColumn("_mix_before", F.sum(words).over(in_order) - words)
        .filter((F.col("_mix_before") <= F.col("_mix_left")) & (F.col("_mix_left") < F.col("_mix_before") + words))
        .select(
            F.col("_mix_source").alias("_mix_s"),
            F.struct(F.col("_mix_key").alias("k"), F.col("_mix_id").alias("i"), F.col("size").alias("s")).alias("_mix_cut"),
            F.floor((F.col("_mix_left") - F.col("_mix_before")) / F.col("_mix_rows")).cast("long").alias("_mix_each"),
        )
    )
    plan = of_source(targets, cut, F.col("_mix_source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s")
    plan = work_table(plan, "mix-plan")

    here = F.struct(F.col("_mix_key").alias("k"), F.col("_mix_id").alias("i"), F.col("size").alias("s"))
    chosen = here < F.col("_mix_cut")
    part = F.when(chosen, F.col("size")).when(here == F.col("_mix_cut"), F.col("_mix_each")).otherwise(0)
    picked = chosen | ((here == F.col("_mix_cut")) & (F.col("_mix_each") * 2 > F.col("size")))
    out = of_source(rows, plan, F.col(source).eqNullSafe(F.col("_mix_source")))
    return out.withColumn("taken", (F.col("_mix_epochs") * F.col("size") + part).cast("long")).withColumn(
        "copies", (F.col("_mix_epochs") + F.when(picked, 1).otherwise(0)).cast("int")
    ).drop(*[c for c in out.columns if c.startswith("_mix")])
