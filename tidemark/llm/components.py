"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, its result is written to the shared scratch folder, and nothing but the
number of links and a checksum comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import work_table


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(r)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()


#: Links that one task of a step takes.
LINKS_PER_TASK = 250_000


def _dealt(links: DataFrame, n: int) -> DataFrame:
    """``links`` in as many partitions as ``n`` rows need; a step over few links is then one short task."""
    return links.coalesce(max(1, math.ceil(n / LINKS_PER_TASK)))


def connected(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every end of ``links`` (u, v); root is the smallest node of the component."""
    links = work_table(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = _state(links)
    while state[0]:
        links = work_table(_small_star(_large_star(_dealt(links, state[0]))), label)
        if (now := _state(links)) == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
