"""Sharding by fixed virtual slots.

Records are hashed once, by id, into a fixed number of virtual slots (thousands). Only the bytes of
each slot are aggregated; a versioned map says which shard holds which slot. Rebalancing edits the
map and never rehashes a record: version n + 1 moves whole slots, from shards that hold more than their share.
Version 1 knows no bytes and deals slots in turn; each run edits the newest version of its store.

Null ids are hashed by their text's checksum, so they spread. Rows that repeat an id share its slot, and are
ordered by checksum and size. A null or empty text has size 1; a text of any length is one record. Other columns are not carried. An empty table gives an empty result and a
map with every slot. The driver holds one number pair for each slot, whatever the input's size.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot. The weights are bytes of each slot when the version was made."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        """Version 1: slots in turn."""
        if shards < 1:
            raise ValueError("shards must be positive")
        return cls(1, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, weights: list[int], shards: int | None = None) -> SlotMap:
        """The next version, for `shards` shards (as before, if None): moves only slots that a shard holds over its fair share, and all slots of shards that are gone."""
        shards = shards or self.shards
        place, load = list(self.shard_of), [0] * shards
        homeless = []
        for slot, s in enumerate(place):
            if s < shards:
                load[s] += weights[slot]
            else:
                homeless.append(slot)
        fair = sum(weights) / shards
        for slot in sorted((i for i, s in enumerate(place) if s < shards), key=lambda i: (-weights[i], i)):
            s = place[slot]
            if load[s] - weights[slot] >= fair and weights[slot]:
                load[s] -= weights[slot]
                homeless.append(slot)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda i: (-weights[i], i)):
            x, s = heapq.heappop(heap)
            place[slot] = s
            heapq.heappush(heap, (x + weights[slot], s))
        _evened(place, weights, shards)
        return SlotMap(self.version + 1, shards, tuple(place))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of maps; earlier versions stay."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/map_version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in _store.names(spark, path) if n.startswith("map_version="))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/map_version={version}").orderBy("virtual_slot").collect()
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def _evened(place: list[int], weights: list[int], shards: int, rounds: int = 2000) -> None:
    """Swaps a slot of the heaviest shard for a lighter one of the lightest (or for none) while that brings them closer."""
    held = [sorted((weights[i], i) for i, s in enumerate(place) if s == k) for k in range(shards)]
    load = [sum(w for w, _ in own) for own in held]
    for _ in range(rounds):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap, best = load[high] - load[low], None
        for w, i in held[high]:
            at = bisect.bisect_left(held[low], (w - gap // 2, -1))
            for other in (*held[low][max(0, at - 1) : at + 1], (0, None)):
                left = abs(gap - 2 * (w - other[0]))
                if left < gap and (best is None or left < best[0]):
                    best = left, (w, i), other
        if best is None:
            return
        _, (w, i), (v, j) = best
        held[high].remove((w, i))
        bisect.insort(held[low], (w, i))
        place[i] = low
        if j is not None:
            held[low].remove((v, j))
            bisect.insort(held[high], (v, j))
            place[j] = high
        load[high] += v - w
        load[low] += w - v


def slotted(records: DataFrame, key: str, slots: int = SLOTS, spare: str | None = None) -> DataFrame:
    """records with the column virtual_slot, which only the key decides; where it is null, the column `spare` does."""
    h = F.xxhash64(F.col(key))
    if spare:
        h = F.when(F.col(key).isNull(), F.xxhash64(F.col(spare))).otherwise(h)
    return records.withColumn("virtual_slot", F.pmod(h, F.lit(slots)).cast("int"))


def slot_weights(records: DataFrame, size: str, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. One row for each slot reaches the driver."""
    weights, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect():
        weights[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    return weights, rows


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) in one of `shards` shards of nearly equal bytes.

    Gives doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (the row's place in its shard,
    from 0 without gaps, by virtual slot and then doc_id), virtual_slot and map_version. The newest slot map of the
    folder `store` (a new shared one, if None), or version 1, is edited for these records and saved as the next version.
    """
    spark = docs.sparkSession
    sized = slotted(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "doc_id",
        slots,
        "text_crc32",
    )
    sized = _store.cut(sized, "shard-sizes")
    weights, rows = slot_weights(sized, "size", slots)
    store = store or _store.folder(spark, "slot-map")
    known = SlotMap.versions(spark, store)
    now = SlotMap.load(spark, store, known[-1]) if known else SlotMap.first(slots, shards)
    if len(now.shard_of) != slots:
        raise ValueError("the stored map has another number of slots")
    if not known:
        now.save(spark, store)
    slot_map = now.rebalanced(weights, shards)
    slot_map.save(spark, store)
    before, first = [0] * shards, []
    for slot, s in enumerate(slot_map.shard_of):
        first.append(before[s])
        before[s] += rows[slot]
    # One row for each slot, so the size of this broadcast does not follow the input.
    table = spark.createDataFrame(list(zip(range(slots), slot_map.shard_of, first, strict=True)), "virtual_slot int, shard int, first long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        sized.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(table), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
    )
