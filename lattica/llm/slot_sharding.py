"""Sharding through fixed virtual slots.

A row's hash gives one of a few thousand slots, for good; of repeated rows (one id, size and
CRC), which count as copies 0, 1, ... of one row, each copy hashes on its own. Bytes are
aggregated for each slot; a versioned slot map says which shard owns a slot. The first version places slots
by descending bytes on the least loaded shard; a later one is an edit: only as many
slots move as the new or light shards need, all others stay. The driver holds the slot
totals and the map, whose size is the number of slots, never the rows.

The law is ``bytes``: shards are near equal in bytes. A row's place in its shard is the
number of rows in the shard's earlier slots (from the slot totals) plus its rank in its
own slot, so ranking is parallel over slots and no shard is sorted as a whole.

The query stores the map and its next version, the edit for one shard more, and reports
both owners of each row's slot.

Defined results: a null text has size 8 and the CRC of no bytes; a text of any length is one
row of its size; repeated rows are spread over the slots like others; a null id hashes by its
text alone; other columns are ignored; an empty table gives an empty result and maps by slot
number.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import checkpoint_folder, saved

SLOTS, SHARDS = 8192, 24
ROW_BYTES = 8
#: Copies of a row that are made at once.
COPIES = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version and owner of each slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def first(loads: dict[int, int], slots: int, shards: int) -> SlotMap:
        """Slots by descending bytes, each to the shard with the fewest."""
        heap, owner = [(0, 0, s) for s in range(shards)], [0] * slots  # bytes, then slots, then the shard's number
        for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
            held, n, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (held + loads.get(slot, 0), n + 1, shard))
        return SlotMap(1, shards, tuple(owner))

    def rebalanced(self, loads: dict[int, int], shards: int) -> SlotMap:
        """The next version for at least as many shards: each old shard gives up its
        smallest slots down to the new mean, and these go to the lightest new shards."""
        if shards < self.shards:
            raise ValueError("a map grows; it does not lose shards")
        mean = sum(loads.values()) / shards
        held = [0] * shards
        for slot, shard in enumerate(self.owner):
            held[shard] += loads.get(slot, 0)
        owner, heap = list(self.owner), [(held[s], s) for s in range(self.shards, shards)]
        heapq.heapify(heap)
        for slot in sorted(range(len(owner)), key=lambda s: (loads.get(s, 0), s)) if heap else ():
            size, old = loads.get(slot, 0), owner[slot]
            if size and held[old] - size >= mean and heap[0][0] + size <= mean * 1.001:
                got, new = heapq.heappop(heap)
                heapq.heappush(heap, (got + size, new))
                held[old] -= size
                owner[slot] = new
        return SlotMap(self.version + 1, shards, tuple(owner))

    def table(self, spark: SparkSession) -> DataFrame:
        """(map_version, shards, vslot, shard): what is stored beside the data."""
        return spark.createDataFrame([(self.version, self.shards, i, s) for i, s in enumerate(self.owner)], "map_version int, shards int, vslot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds this version to the maps in ``folder``; a version is never overwritten."""
        self.table(spark).coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{folder}/version={version}").select("vslot", "shard", "shards").collect())
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, vslot), a row for every row of ``docs``.

    Equal rows are combined before they shuffle and made again from their number, in
    two steps so that no array grows with it.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least("n", (F.col("part") + 1) * COPIES) - 1))).drop("n", "part")
    return copies.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most the number of slots."""
    return {r.vslot: (r.size, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}


def placed(rows: DataFrame, slot_map: SlotMap, held: dict[int, tuple[int, int]], after: SlotMap | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in its shard, gapless from 0,
    and ``next_shard`` by the map ``after``."""
    spark, ahead, owned = rows.sparkSession, [0] * slot_map.shards, []
    for vslot, (shard, new) in enumerate(zip(slot_map.owner, (after or slot_map).owner, strict=True)):
        owned.append((vslot, shard, ahead[shard], new))
        ahead[shard] += held.get(vslot, (0, 0))[1]
    table = F.broadcast(spark.createDataFrame(owned, "vslot int, shard int, ahead long, next_shard int"))  # a row for each slot
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return rows.withColumn("rank", rank).join(table, "vslot").withColumn("slot", F.col("ahead") + F.col("rank") - 1).drop("rank", "ahead")


def op7_slot_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and place under the law of near-equal bytes, and its shard
    after an edit of the map for one shard more."""
    rows = saved(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    held = totals(rows)
    loads = {s: b for s, (b, _) in held.items()}
    folder = f"{checkpoint_folder(spark).rstrip('/')}/slot-maps-{uuid.uuid4().hex}"
    SlotMap.first(loads, SLOTS, SHARDS).save(spark, folder)
    first = SlotMap.load(spark, folder, 1)
    first.rebalanced(loads, SHARDS + 1).save(spark, folder)
    return placed(rows, first, held, SlotMap.load(spark, folder, 2)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(first.version).alias("map_version"), "next_shard"
    )
