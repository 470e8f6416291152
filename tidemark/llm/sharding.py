"""Sharding through fixed virtual slots.

A record hashes into one of ``n_slots`` slots for good. Bytes are summed per slot, and a stored map, numbered by
version, says which shard a slot belongs to. Version 0 deals slots out in turn; rebalancing writes a new version in
which slots have moved from full shards to empty ones, and leaves the earlier versions as they were.

The law is ``bytes``: sums of sizes per shard are near equal. Only the slot totals, ``n_slots`` rows at most, come to
the driver; records are placed by a join with the map, which has ``n_slots`` rows and so is safe to broadcast.

One slot is the least that moves: where a slot (one identifier of many rows, all null identifiers) holds more than a
shard's share, its shard stays above the mean, and the rest are evened out among themselves. Records are dealt by
identifier, so equal texts of different identifiers may lie in different shards.

Cases: null text counts no bytes and the checksum of the empty text; a null identifier hashes like any value; rows
that repeat an identifier share a slot; an empty table gives an empty result; other columns pass through, except
those named like the ones added.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, work_table

N_SLOTS = 8192
#: The gap between the fullest and the emptiest shard, as a part of the mean, that is left as it is.
TOLERANCE = 0.001
#: Finer parts of a slot in which records are numbered.
N_PARTS = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_bytes(df: DataFrame, key: str, size: Column, n_slots: int = N_SLOTS) -> DataFrame:
    return df.groupBy(slot_of(F.col(key), n_slots).alias("virtual_slot")).agg(F.sum(size).alias("bytes"))


class SlotMap:
    """Versions of a slot-to-shard map in a folder that Spark reads and writes: ``path/version=N``."""

    def __init__(self, spark: SparkSession, path: str, n_slots: int = N_SLOTS) -> None:
        self.spark, self.path, self.n_slots = spark, path, n_slots

    def store(self, version: int, shards: list[int]) -> None:
        rows = [(slot, int(shard)) for slot, shard in enumerate(shards)]
        self.spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")

    def shards(self, version: int) -> list[int]:
        """At most ``n_slots`` rows."""
        out = [0] * self.n_slots
        for r in self.read(version).collect():
            out[r.virtual_slot] = r.shard
        return out

    def create(self, n_shards: int) -> int:
        self.store(0, [slot % n_shards for slot in range(self.n_slots)])
        return 0

    def rebalance(self, version: int, totals: DataFrame, n_shards: int) -> int:
        """A new version for ``n_shards`` (more or fewer than before, too) by moving as few slots as even sums allow."""
        sums = {r.virtual_slot: r.bytes for r in totals.collect()}  # n_slots rows at most
        self.store(version + 1, rebalanced(self.shards(version), sums, n_shards))
        return version + 1


def rebalanced(shards: list[int], sums: dict[int, int], n_shards: int) -> list[int]:
    """Slots leave shards above the mean, largest that fits first, for the emptiest shard; then pairs are evened out."""
    shards = list(shards)
    mean = sum(sums.values()) / n_shards
    load = [0] * n_shards
    members: list[list[int]] = [[] for _ in range(n_shards)]
    moving = []
    for slot, shard in enumerate(shards):
        if shard >= n_shards:
            moving.append(slot)
        elif sums.get(slot):
            members[shard].append(slot)
            load[shard] += sums[slot]
    for shard in range(n_shards):
        for slot in sorted(members[shard], key=lambda s: (-sums[s], s)):
            if load[shard] - sums[slot] >= mean or len(members[shard]) > 1 and load[shard] - mean > sums[slot] / 2:
                load[shard] -= sums[slot]
                members[shard].remove(slot)
                moving.append(slot)
    free = [(load[shard], shard) for shard in range(n_shards)]
    heapq.heapify(free)
    for slot in sorted(moving, key=lambda s: (-sums.get(s, 0), s)):
        least, shard = heapq.heappop(free)
        shards[slot] = shard
        heapq.heappush(free, (least + sums.get(slot, 0), shard))
    even_out(shards, sums, n_shards)
    return shards


def even_out(shards: list[int], sums: dict[int, int], n_shards: int) -> None:
    """Swaps slots (or moves one) between the fullest and the emptiest shard while that narrows their gap.

    A step takes the pair of slots whose difference comes nearest to half of the gap. It ends at a gap of ``TOLERANCE``
    of the mean. A shard that no pair helps (it holds one slot above a shard's share) is left and the others go on.
    """
    members: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shards):
        if sums.get(slot):
            members[shard].append((sums[slot], slot))
    for m in members:
        m.sort()
    load = [sum(size for size, _ in m) for m in members]
    going = set(range(n_shards))
    for _ in range(len(shards)):
        full, empty = max(going, key=lambda k: (load[k], k)), min(going, key=lambda k: (load[k], k))
        gap = load[full] - load[empty]
        if gap <= TOLERANCE * sum(load) / n_shards:
            return
        best: tuple | None = None
        partners = [(0, -1), *members[empty]]
        for size, slot in members[full]:
            at = bisect.bisect_left(partners, (size - gap // 2, -1))
            for other in partners[max(0, at - 1) : at + 1]:
                if 0 < size - other[0] < gap and (best is None or abs(2 * (size - other[0]) - gap) < best[0]):
                    best = (abs(2 * (size - other[0]) - gap), (size, slot), other)
        if best is None:
            going.discard(full)
            continue
        for item, source, target in [(best[1], full, empty), (best[2], empty, full)]:
            if item[1] >= 0:
                members[source].remove(item)
                bisect.insort(members[target], item)
                shards[item[1]] = target
                load[source] -= item[0]
                load[target] += item[0]


def place(df: DataFrame, key: str, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``df`` with virtual_slot and shard; no shuffle, for the map has ``n_slots`` rows."""
    kept = df.drop("virtual_slot", "shard")
    return kept.withColumn("virtual_slot", slot_of(F.col(key), n_slots)).join(F.broadcast(slot_map), "virtual_slot", "left")


def balanced_map(df: DataFrame, key: str, size: Column, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of a fresh map: dealt in turn, then rebalanced by the bytes of ``df``."""
    slots = SlotMap(df.sparkSession, scratch_path(df.sparkSession, "slot-map"), n_slots)
    first = slots.create(n_shards)
    return slots.read(slots.rebalance(first, slot_bytes(df, key, size, n_slots), n_shards))


def number_in_shard(placed: DataFrame, cols: list[str], part_key: Column, n_parts: int = N_PARTS) -> DataFrame:
    """(cols, virtual_slot, shard, slot): ``slot`` counts the records of each shard from 0 without gaps.

    Equal records collapse before they are sorted; records are ordered within parts of a virtual slot, and the sums
    of the parts before them in their shard are added.
    """
    equal = (
        placed.withColumn("_part", F.pmod(part_key, F.lit(n_parts)).cast("int"))
        .groupBy("shard", "virtual_slot", "_part", *cols)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    equal = work_table(equal, "shard-records")
    parts = equal.groupBy("shard", "virtual_slot", "_part").agg(F.sum("_rows").alias("_in_part"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_offset", F.sum("_in_part").over(before) - F.col("_in_part")).drop("_in_part")
    here = Window.partitionBy("shard", "virtual_slot", "_part").orderBy(*[F.col(c).asc_nulls_first() for c in cols]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = equal.withColumn("_first", F.sum("_rows").over(here) - F.col("_rows")).join(parts, ["shard", "virtual_slot", "_part"])
    start = F.col("_offset") + F.col("_first")
    return numbered.withColumn("slot", F.explode(F.sequence(start, start + F.col("_rows") - 1))).drop("_offset", "_first", "_rows", "_part")
