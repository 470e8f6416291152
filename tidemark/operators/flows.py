"""Flows: entries that share identifiers, directly or through other entries.

Entries and their identifiers (correlation keys and trace identifiers, each by name and value) are a bipartite graph; a
flow is a connected part of it. An entry only matters for the identifiers that it ties together, so the graph is reduced
to distinct pairs of identifiers, the smallest one of an entry with each of its others, and entries never meet at an
identifier. Labels are then spread:

1. every identifier takes the smallest label among its own and those of its neighbours, and then that label's label;
2. this is repeated until no label changes; each round is stored, and only a count comes to the driver.

An identifier of very many pairs is no task's own: minima are combined before they are shuffled, and where its label is
joined to its pairs, identifiers of more than ``HOT`` pairs are dealt into ``SALT`` parts, their labels copied to each.

An addition: entries carry ``flow_id``, which nothing else fills. Entries without identifiers have none; empty values are
no identifiers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.stored import light, settled

#: Pairs of an identifier from which on it is dealt into parts, and how many.
HOT, SALT = 10_000, 32


def identifiers(names: Iterable[str] | None = None) -> Column:
    """Sorted distinct 'name=value' of an entry; ``names``: of these keys only, trace_id among them."""
    pairs = F.transform(F.map_entries(F.coalesce("correlation_keys", F.create_map().cast("map<string,string>"))), lambda e: F.when(e["value"] != "", F.concat_ws("=", e["key"], e["value"])))
    wanted = None if names is None else set(names)
    if wanted is not None:
        pairs = F.filter(pairs, lambda x: F.substring_index(x, "=", 1).isin(*wanted))
    trace = F.array(F.when(F.coalesce("trace_id", F.lit("")) != "", F.concat(F.lit("trace_id="), F.col("trace_id"))))
    every = pairs if wanted is not None and "trace_id" not in wanted else F.concat(pairs, trace)
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def _ties(entries: DataFrame, names: Iterable[str] | None) -> DataFrame:
    """(u, v): the distinct pairs of identifiers that entries tie together, both ways, and each with itself."""
    held = entries.select(identifiers(names).alias("ids")).filter(F.size("ids") > 0)
    ways = F.flatten(F.transform("ids", lambda v: F.array(F.struct(F.col("ids")[0].alias("u"), v.alias("v")), F.struct(v.alias("u"), F.col("ids")[0].alias("v")), F.struct(v.alias("u"), v.alias("v")))))
    return held.select(F.explode(F.array_distinct(ways)).alias("x")).select("x.u", "x.v").distinct()


def _with_label(rows: DataFrame, on: str, labels: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` with the label of ``on`` from ``labels`` (id, label); rows of hot identifiers are dealt by ``by``."""
    if light(labels, "id", "label"):
        return rows.join(F.broadcast(labels), F.col(on) == F.col("id")).drop("id")
    marked = rows.join(hot.select(F.col("id").alias("_hot")), F.col(on) == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALT))).otherwise(0))
    parts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    dealt = labels.join(hot.select(F.col("id").alias("_hot")), F.col("id") == F.col("_hot"), "left").select("id", "label", F.explode(parts).alias("_salt"))
    return marked.drop("_hot").join(dealt, (F.col(on) == F.col("id")) & (F.col("_part") == F.col("_salt"))).drop("id", "_part", "_salt")


def flow_labels(entries: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(id, label): for each identifier the smallest one of its flow; stored."""
    ties = settled(_ties(entries, names))
    degrees = ties.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hot = settled(degrees.filter(F.col("n") > HOT).select("id"))
    hot = F.broadcast(hot) if light(hot, "id") else hot
    labels = settled(degrees.select("id", F.col("id").alias("label")))
    while True:
        near = _with_label(ties, "v", labels, hot, "u").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("label"))
        near = settled(near)
        onward = _with_label(near.select(F.col("id").alias("node"), F.col("label").alias("via")), "via", near, hot, "node")
        spread = settled(onward.select(F.col("node").alias("id"), F.least("via", "label").alias("label")))
        changed = spread.join(labels.withColumnRenamed("label", "was"), "id").filter("label != was").limit(1).count()
        labels = spread
        if not changed:
            return labels


def with_flow_ids(entries: DataFrame, labels: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """``entries`` with the flow_id of their identifiers, from ``flow_labels``."""
    known = labels.select(F.col("id").alias("_id"), F.left(F.sha2("label", 256), F.lit(16)).alias("_flow"))
    rows = entries.withColumn("_first", F.get(identifiers(names), F.lit(0)))
    if light(known, "_id", "_flow"):
        joined = rows.join(F.broadcast(known), F.col("_first") == F.col("_id"), "left")
    else:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("file_id", "line_no", "seq"), F.lit(SALT)))
        joined = rows.join(known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), (F.col("_first") == F.col("_id")) & (F.col("_part") == F.col("_salt")), "left").drop("_part", "_salt")
    return joined.withColumn("flow_id", F.col("_flow")).drop("_id", "_flow", "_first")


def flows(entries: DataFrame) -> DataFrame:
    """(flow_id, n, services, first, last) of entries with a flow_id."""
    held = entries.filter("flow_id is not null").groupBy("flow_id")
    return held.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("service")).alias("services"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
