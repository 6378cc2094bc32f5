"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Each record is hashed into one of a fixed number of virtual slots. Rows and
bytes are summed for each slot, and a map from slots to shards, whose size is
that fixed number whatever the data, is built so that shards hold nearly equal
bytes. Rebalancing edits the stored map, as a new version, and moves as few
slots as it can; records never change their slot.

Defined cases: a null text has no bytes (size is the overhead alone, CRC of
the empty text); the slot key is the id together with the text's CRC, so rows
that share an id but not a text are spread; rows of equal texts and different
ids go to slots of their own, so that a large group of copies spreads over all
shards (the law is of bytes, not of texts); a very long text is one record of
its size; an empty table gives no rows and a map that deals its empty slots in
turn; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, work_path

SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot; ``version`` counts edits."""

    shards: int
    assignment: tuple[int, ...]
    version: int = 1

    @classmethod
    def build(cls, slot_bytes: list[int], shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far (ties: the fewest slots, so empty ones are dealt in turn)."""
        heap = [(0, 0, s) for s in range(shards)]
        out = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            load, held, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + slot_bytes[slot], held + 1, shard))
        return cls(shards, tuple(out))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.assignment):
            out[shard] += slot_bytes[slot]
        return out

    def rebalance(self, slot_bytes: list[int], shards: int) -> SlotMap:
        """The next version for ``shards`` >= the present count.

        Slots move only from shards above the mean to the one with the least
        load, while that brings the two closer together.
        """
        if shards < self.shards:
            raise ValueError("a map can grow but not shrink")
        out, load = list(self.assignment), self.loads(slot_bytes) + [0] * (shards - self.shards)
        mean = sum(load) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot in sorted(range(len(out)), key=lambda s: (slot_bytes[s], s)):
            held[out[slot]].append(slot)
        heap = [(load[s], s) for s in range(shards)]
        heapq.heapify(heap)
        for shard in sorted(range(self.shards), key=lambda s: (-load[s], s)):
            while held[shard] and load[shard] > mean:
                least, to = heap[0]
                size = slot_bytes[held[shard][-1]]
                if to == shard or least + size >= load[shard]:
                    held[shard].pop()
                    continue
                slot = held[shard].pop()
                out[slot], load[shard], load[to] = to, load[shard] - size, least + size
                heapq.heapreplace(heap, (load[to], to))
        return replace(self, shards=shards, assignment=tuple(out), version=self.version + 1)

    def table(self, spark: SparkSession, slot_rows: list[int] | None = None) -> DataFrame:
        """Rows ``version, shards, virtual_slot, shard, first`` where ``first`` counts
        the shard's records in earlier slots."""
        at, first = [0] * self.shards, []
        for slot, shard in enumerate(self.assignment):
            first.append(at[shard])
            at[shard] += slot_rows[slot] if slot_rows else 0

        def pick(values):
            return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), (F.col("id") + 1).cast("int"))

        return spark.range(len(self.assignment)).select(
            F.lit(self.version).alias("version"),
            F.lit(self.shards).alias("shards"),
            F.col("id").alias("virtual_slot"),
            pick(self.assignment).cast("int").alias("shard"),
            pick(first).cast("long").alias("first"),
        )

    @classmethod
    def load(cls, table: DataFrame) -> SlotMap:
        rows = table.orderBy("virtual_slot").collect()
        return cls(rows[0]["shards"], tuple(r["shard"] for r in rows), rows[0]["version"])


def records(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each row."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
    )
    return slim.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)))


def shard(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    previous: SlotMap | None = None,
) -> tuple[DataFrame, SlotMap, str]:
    """Placed records, the map they follow and the folder of its stored table.

    Columns: ``doc_id, size, text_crc32, virtual_slot, shard, slot,
    map_version``; ``slot`` numbers a shard's records from 0 without gaps.
    The per-slot sums that come to the driver are ``slots`` rows at most.
    """
    spark = docs.sparkSession
    rows = materialise(records(docs, id_col, text_col, slots), "shard-records")
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    slot_map = previous.rebalance(size, shards) if previous else SlotMap.build(size, shards)
    path = work_path(spark, f"slot-map-v{slot_map.version}")
    table = slot_map.table(spark, count)
    table.coalesce(1).write.parquet(path)
    stored = spark.read.schema(table.schema).parquet(path)
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    placed = rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(F.broadcast(stored), "virtual_slot")
    return (
        placed.select(
            "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank")).alias("slot"), F.col("version").alias("map_version")
        ),
        slot_map,
        path,
    )
