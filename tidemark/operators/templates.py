"""Templates of messages: a prefix tree of fixed depth over token patterns, the same for any partitioning.

1. Of a message's first line every run of characters that holds a digit becomes a placeholder; what is left are patterns.
   They are counted with their first and last time by service, which Spark combines before it shuffles; everything after
   that works on distinct patterns.
2. Patterns of a service and a number of tokens go down the tree by their first ``depth`` tokens. A node with more than
   ``most`` different tokens below it has one child for all of them, the placeholder.
3. In a leaf, a later place with more than ``most`` different tokens becomes a placeholder as well.

Each step counts distinct tokens of nodes, first by node and token and then by node, so a node that holds most patterns is
spread. Whether a place is wide depends on counts alone, not on the order in which messages come.

An addition: entries carry ``template_id``, which nothing else fills. Null and blank messages have no template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.stored import light, settled

ANY = "<*>"
#: A run of characters that holds a digit, between blanks and brackets, quotes and separators.
VARYING = r"""[^\s=,;:()\[\]{}"'<>|]*[0-9][^\s=,;:()\[\]{}"'<>|]*"""
#: Parts into which the entries of one pattern are dealt when they are joined with patterns that cannot be broadcast.
SALT = 32


def pattern_of(message: Column) -> Column:
    """The first line with placeholders for what varies, tokens parted by one space; null if it is blank."""
    first = F.substring_index(F.coalesce(message, F.lit("")), "\n", 1)
    masked = F.regexp_replace(first, VARYING, ANY)
    return F.nullif(F.trim(F.regexp_replace(masked, r"\s+", " ")), F.lit(""))


def patterns(entries: DataFrame) -> DataFrame:
    """(service, pattern, n, first, last) of ``entries`` (service, message, timestamp)."""
    rows = entries.select(F.coalesce("service", F.lit("")).alias("service"), pattern_of(F.col("message")).alias("pattern"), "timestamp").filter("pattern is not null")
    return rows.groupBy("service", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _wide(places: DataFrame, most: int) -> DataFrame:
    """Keys of ``places`` (key, token) with more than ``most`` different tokens."""
    each = places.groupBy("key", "token").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("_tokens")).filter(F.col("_tokens") > most).select("key", F.lit(True).alias("wide"))


def tree(found: DataFrame, depth: int = 3, most: int = 20) -> DataFrame:
    """``found`` (service, pattern, ...) with the template of each pattern; ``found`` is stored."""
    tokens = F.split("pattern", " ")
    rows = found.withColumn("_tokens", tokens).withColumn("_node", F.concat_ws(" ", "service", F.size("_tokens").cast("string"))).withColumn("_path", F.array().cast("array<string>"))
    for level in range(depth):
        here = F.get("_tokens", F.lit(level))
        wide = _wide(rows.select(F.col("_node").alias("key"), here.alias("token")).filter("token is not null"), most)
        rows = rows.join(wide.withColumnRenamed("key", "_key"), F.col("_node") == F.col("_key"), "left").drop("_key")
        step = F.when(F.col("wide"), F.lit(ANY)).otherwise(here)
        rows = rows.withColumn("_step", F.when(here.isNotNull(), step))
        rows = rows.withColumn("_path", F.when(F.col("_step").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array("_step"))))
        rows = settled(rows.withColumn("_node", F.concat_ws(" ", "_node", "_step")).drop("wide", "_step"))
    # What follows the path of a leaf, place by place.
    rest = rows.select("_node", F.posexplode(F.slice("_tokens", depth + 1, 1 << 30)).alias("place", "token"))
    wide = _wide(rest.select(F.struct("_node", "place").alias("key"), "token"), most)
    by_leaf = wide.groupBy("key._node").agg(F.collect_set("key.place").alias("_wide")).withColumnRenamed("_node", "_leaf")  # no more places than a pattern has
    rows = rows.join(by_leaf, F.col("_node") == F.col("_leaf"), "left")
    tail = F.transform(F.slice("_tokens", depth + 1, 1 << 30), lambda t, i: F.when(F.array_contains(F.coalesce("_wide", F.array().cast("array<int>")), i), F.lit(ANY)).otherwise(t))
    return rows.withColumn("template", F.array_join(F.concat("_path", tail), " ")).select(*found.columns, "template")


def template_id(service: Column, template: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\n", service, template), 256), F.lit(16))


def mine(entries: DataFrame, depth: int = 3, most: int = 20) -> DataFrame:
    """(service, pattern, n, first, last, template, template_id) of all patterns of ``entries``; stored."""
    found = tree(settled(patterns(entries)), depth, most)
    return settled(found.withColumn("template_id", template_id(F.col("service"), F.col("template"))))


def templates(mined: DataFrame) -> DataFrame:
    """(service, template, template_id, n, first, last) from ``mine``."""
    return mined.groupBy("service", "template", "template_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def with_template_ids(entries: DataFrame, mined: DataFrame) -> DataFrame:
    """``entries`` with the template_id that ``mine`` found; a pattern of very many entries is joined in parts."""
    known = mined.select(F.col("service").alias("_service"), F.col("pattern").alias("_pattern"), F.col("template_id").alias("_found"))
    rows = entries.withColumn("_of", pattern_of(F.col("message")))
    same = (F.coalesce("service", F.lit("")) == F.col("_service")) & (F.col("_of") == F.col("_pattern"))
    if light(known, "_service", "_pattern"):
        joined = rows.join(F.broadcast(known), same, "left")
    else:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("file_id", "line_no", "seq"), F.lit(SALT)))
        joined = rows.join(known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), same & (F.col("_part") == F.col("_salt")), "left").drop("_part", "_salt")
    return joined.withColumn("template_id", F.col("_found")).drop("_service", "_pattern", "_found", "_of")
